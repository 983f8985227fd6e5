"""What becomes of changes, worked out one by one: the brute force that the stream is held against."""

import datetime
import math
import zlib
from collections import defaultdict


def play(batches, rows, patience=3):
    """rows: (batch, day, change_id, client_id, n, op, city, balance) -> {change_id: [client_id, status, batch, missed, city, balance, current]}."""
    out, clients, largest = {}, defaultdict(lambda: {"next": 1, "held": {}, "city": None, "balance": None, "last": None}), None

    def apply(c, s, b, missed=0):
        while s["next"] in s["held"]:
            _, change, op, city, balance = s["held"].pop(s["next"])
            if op == "I":
                s["city"], s["balance"] = city, balance
            elif op == "U":
                s["city"], s["balance"] = s["city"] if city is None else city, s["balance"] if balance is None else balance
            elif op == "D":
                s["city"] = s["balance"] = None
            out[change] = [c, "applied", b, missed, s["city"], s["balance"], False]
            s["last"], missed = (change, op), 0
            s["next"] += 1

    for b in range(1, batches + 2):
        for c, s in clients.items():
            while s["held"] and (b > batches or (largest is not None and min(x[0] for x in s["held"].values()) + patience <= largest)):
                to = min(s["held"])
                missed, s["next"] = to - s["next"], to
                apply(c, s, b, missed)
        mine = sorted(x[1:] for x in rows if x[0] == b)
        for day, change, c, n, op, city, balance in mine:
            s = clients[c]
            if n in s["held"] or n < s["next"]:
                out[change] = [c, "rejected", b, 0, None, None, False]
            else:
                s["held"][n] = (day, change, op, city, balance)
                apply(c, s, b)
        largest = max([x[0] for x in mine] + ([] if largest is None else [largest]), default=None)
    for s in clients.values():
        if s["last"] and s["last"][1] != "D":
            out[s["last"][0]][-1] = True
    return out


def query(changes):
    """The same for distinct rows of the table ``client_changes`` (dicts), by the rules of its query."""
    numbers = defaultdict(set)
    for r in changes:
        numbers[r["client_id"]].add(r["seq"])
    ranks = {c: {s: k + 1 for k, s in enumerate(sorted(v))} for c, v in numbers.items()}
    rows = []
    for r in changes:
        h = zlib.crc32(str(r["change_id"]).encode())
        if r["valid_at"] is None or h % 11 == 0:
            continue
        day = (r["valid_at"].date() - datetime.date(1970, 1, 1)).days + 9 * (h % 4)
        rows.append((max(1, min(12, 1 + math.floor((day - 19723) * 12 / 160))), day, r["change_id"], r["client_id"], ranks[r["client_id"]][r["seq"]], r["op"], r["city"], r["balance"]))
    cents = lambda x: None if x is None else math.floor(100 * x + 0.5)
    return {k: (*v[:5], cents(v[5]), v[6]) for k, v in play(12, rows).items()}
