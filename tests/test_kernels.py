import random
from fractions import Fraction

import pytest

from tallyworks.functions import answers, calculation, canonical, exact, grammar
from tallyworks.functions.question import numbers


@pytest.mark.parametrize("text,shown", [(".5", "0.5"), ("12.000", "12"), ("3/5", "0.6"), ("-6/8", "-0.75"), ("1/3", "0.3333333333"), ("-2/3", "-0.6666666667"), ("1,000", "1000"), (" 7 ", "7"), ("1/0", None), ("1,00", None), ("+3", None), ("1e3", None), ("", None), (None, None)])
def test_numbers_as_text(text, shown):
    assert exact.normal(text) == shown


def test_stated_precision():
    assert all(exact.accepts(x, Fraction(1, 3)) for x in (".3", ".33", "0.333")) and not exact.accepts(".34", Fraction(1, 3))
    assert [exact.accepts(x, Fraction(6, 7)) for x in (".857142857", ".86", ".85", ".87", "1")] == [True, True, True, False, False]
    assert exact.accepts("3.0", Fraction("3.02")) and not exact.same(exact.normal("3.0"), "3.02")
    assert exact.symmetric_error("0", "0") == 0 and exact.symmetric_error("1", "-1") == 2 and exact.symmetric_error("x", "1") is None
    assert exact.scale(Fraction(-3, 2)) == 1.5 and exact.scale(Fraction(1, 3)) == 1.0 and exact.scale(None) is None and exact.finite(Fraction(10**400)) is None


@pytest.mark.parametrize("text,value", [("1+2*3", "7"), ("-7//2", "-4"), ("(1+2)*3", "9"), ("00+1", "1"), ("007.5+0", "7.5"), ("5.+.5", "5.5"), ("1,000+2", "1002"), ("1234,567+0", "1234567"), ("2--3", "5"), ("1+1 # note", "2"), ("(1+\n1)", "2"), ("8/4/2", "1"), ("2-3-4", "-5")])
def test_expressions(text, value):
    assert grammar.evaluate(grammar.parse(text)) == Fraction(value)


@pytest.mark.parametrize("text", ["", "3", "-5", "007+1", "1 2", "1**2", "2(3)", "1+", "(1+2", "1+2)", "1%2", "x+1", "1_0+1", "1e3+1", "0x1+1", "1+\n1", "()+1", "1,2+3", "9" * 51 + "+1", "1" + "+1" * 21, "1" * 257, "1+١"])
def test_refused_expressions(text):
    with pytest.raises(grammar.Refused):
        grammar.parse(text)


def test_the_longest_chain():
    assert grammar.evaluate(grammar.parse("1" + "+1" * 20)) == 21


@pytest.mark.parametrize("text,error", [("<<1+1=2>>", None), ("<<1+1", "unclosed_annotation"), ("<<1+1>>", "missing_equals"), ("<<=x>>", "empty_expression"), ("<<1+1=x>>", "invalid_claimed_result"), ("<<5=5>>", "invalid_expression"), ("<<1/0=0>>", "execution_error"), ("<<1+1=3>>", "incorrect_result"), ("<<1=1=1>>", "invalid_expression"), ("<<9**9=1>>", "invalid_expression"), ("<<6/7=.86>>", None)])
def test_verdicts(text, error):
    (f,) = grammar.formulas(text)
    assert f.error == error and f.correct == (error is None)


def test_step_fields_and_spans():
    text = "So <<  12 + 3 = 15 >> and\n<<15/2=7.5>>7.5\n#### 7.5"
    a, b = grammar.formulas(text)
    assert text[slice(*a.expression_span)] == "12 + 3" and text[slice(*a.claimed_span)] == "15" and text[a.start : a.end] == a.raw
    assert calculation.steps_of(text)[1] and not calculation.steps_of(text.replace("####", "##"))[1]


@pytest.mark.parametrize("text,got", [("#### 3 months", ("fallback", "3")), ("#### 1/0", (None, None)), ("a 30-day trial", (None, None)), ("so 5.\n#### 1,200 ", ("marker", "1200")), ("costs 3 or 4 dollars", ("fallback", "4")), ("#### -1/4", ("marker", "-0.25")), ("version v3.1", (None, None))])
def test_final_answers(text, got):
    m = answers.marked(text)
    f = answers.fallback(text) if m is None else None
    assert got == (("marker", m) if m else ("fallback", f) if f else (None, None))


@pytest.mark.parametrize("question,want", [
    ("The depot holds 2,400 bolts, 2/7 of them rusty; 6.25 kg is spare, forty-three are weighed twice, and the offset is -9.", "2,400=2400 2/7=2/7 6.25=25/4 forty-three=43 twice=2 -9=-9"),
    ("eight two owls", "eight=8 two=2"), ("four and seven litres", "four=4 seven=7"), ("two-fifths remain", "two-fifths=2/5"), ("an eighth is gone", "an eighth=1/8"),
    ("five and two-thirds metres", "five and two-thirds=17/3"), ("3 and a quarter hours", "3 and a quarter=13/4"), ("half dozen plums", "half dozen=6"), ("paid time and a half", "time and a half=3/2"),
    ("Wash a couple of pans once every evening.", "a couple of=2 once=1"), ("On the fifth lap only ones and hundreds of birds are left, says the O. of P.", ""),
    ("nine quarters on the table, but two quarters of the pie", "nine=9 two quarters=1/2"), ("three hundred and six of eighteen thousand two hundred ninety-nine", "three hundred and six=306 eighteen thousand two hundred ninety-nine=18299"),
    ("a half dozen nails, or two and a half dozen", "half dozen=6 two and a half=5/2 dozen=12"), ("hundred stamps", "hundred=100"), ("a third place medal", ""), ("", ""),
])
def test_question_numbers(question, want):
    assert " ".join(f"{question[f.start : f.end]}={f.value}" for f in numbers(question)) == want


@pytest.mark.parametrize("question,want", [
    ("the thirty-fourth visitor", []), ("her forty second sprint", []), ("one thousandth of it", []), ("six point two five litres", []), ("the eleventh", []),
    ("two hundred and first page of nine", [9]), ("fifty seconds", [50]), ("twelve point out the way", [12]), ("seven million and twelve", [7_000_012]), ("the twelfth of 30", [30]),
])
def test_ordinals_and_spoken_decimals_are_no_numbers(question, want):
    assert [f.value for f in numbers(question)] == want


def trimmed(answer):
    out, at = [], 0
    for a, b in canonical.cuts(answer):
        out.append(answer[at:a])
        at = b
    return "".join([*out, answer[at:]])


@pytest.mark.parametrize("answer,want", [
    ("Mara stacks 6 + 9 = <<6+9=15>>15 tiles.", "Mara stacks <<6+9=15>> tiles."), ("Four vans need 4 x $30 = $<<4*30=120>>120.", "Four vans need <<4*30=120>>."),
    ("That is 18 as 3 times 6 equals <<3*6=18>>18.", "<<3*6=18>>."), ("It rose T + 12 + 5 = T + <<+12+5=17>>17.", "<<+12+5=17>>."), ("They cut <<90/6=15>>15 $15 ribbons.", "They cut <<90/6=15>> $15 ribbons."),
    ("Costs £<<7*2=14>>£14 at 7/day", "Costs £<<7*2=14>>£14 at 7/day"), ("24 divided by 6 = <<24/6=4>>4", "<<24/6=4>>"), ("1/2 − 1/4 = <<1/2-1/4=.25>>0.25", "<<1/2-1/4=.25>>"),
    ("nothing closed <<1+1=2", "nothing closed <<1+1=2"), ("a\n3 × 3 = <<3*3=9>>9", "a\n<<3*3=9>>"),
])
def test_repetitions_are_cut(answer, want):
    assert trimmed(answer) == want and canonical.cuts(want) == []


def test_identities():
    assert canonical.drop_identities("a <<21=21.0>>21 g, <<21/3=7>>7, <<1=2>>, <<+5=5>>, <<x=x>>, <<+-3=-3>>") == "a 21 g, <<21/3=7>>7, <<1=2>>, , <<x=x>>, <<+-3=-3>>"


def test_provenance_of_equal_values_and_fractions():
    r = calculation.record("There are 4 crates with 3 items each and 4 extra. Half are red.", "<<4*3=12>> <<12+4=16>> <<16/2=8>> <<1/2=.5>> <<7//2=3>>\n#### 3")
    assert [s["dependencies"] for s in r["steps"]] == [[], [0], [1], [], []]
    assert [[n["kind"] for n in s["nodes"]] for s in r["steps"]][3:] == [["problem_number"], ["literal", "literal", "operation"]]
    assert [s["unresolved"] for s in r["steps"]] == [1, 1, 0, 0, 0] and r["steps"][-1]["is_final"]
    assert r["steps"][3]["actions"][0]["operator"] == "copy" and r["steps"][4]["actions"][0]["supervised"] == "div"
    assert not r["issues"] and all(s["graph_result"] == s["program_result"] == s["target"] for s in r["steps"])
    assert [n["kind"] for n in calculation.record("1/2 of 3", "<<2/4=.5>>")["steps"][0]["nodes"]] == ["literal", "literal", "operation"]


def test_corrupted_programs_are_found():
    graph = calculation.graph_of("There are 4 crates with 3 items.", "<<4-3=1>> <<1+9=10>>")
    codes = lambda p: {c for c, _ in calculation.structure_issues(graph, p)}
    assert codes(calculation.program_of(graph)) == set()
    p = calculation.program_of(graph)
    p["steps"][0]["actions"][0]["operands"].reverse()
    assert codes(p) == {"action_sequence_mismatch"}
    p = calculation.program_of(graph)
    p["steps"][0]["actions"] *= 2
    p["steps"][0]["mask"] *= 2
    assert codes(p) == {"action_count_mismatch", "action_sequence_mismatch"}
    p = calculation.program_of(graph)
    p["steps"][1]["mask"], p["steps"][1]["target_scale"], p["steps"][1]["valid"] = [[True, False]], 1.0, False
    assert codes(p) == {"operand_mask_mismatch", "unresolved_count_mismatch", "target_scale_mismatch", "step_metadata_mismatch"}
    p = calculation.program_of(graph)
    p = calculation.program_of(graph)
    p["steps"][1]["actions"], p["steps"][1]["mask"] = [{"operator": "copy", "operands": []}], [[]]
    assert codes(p) == {"action_sequence_mismatch", "dependency_mismatch"}
    p = calculation.program_of(graph)
    p["numbers"].pop(), p["steps"].pop()
    assert codes(p) == {"problem_number_table_mismatch", "step_count_mismatch"}


def test_random_trees_run_alike():
    rng = random.Random(11)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return [("number", Fraction(rng.randint(-20, 20), rng.randint(1, 7)), ())]
        op = rng.choice(["add", "sub", "mul", "div", "floor_div", "neg", "pos"])
        a = tree(depth - 1)
        if op in ("neg", "pos"):
            return [*a, (op, None, (len(a) - 1,))]
        b = tree(depth - 1)
        if op in ("div", "floor_div") and grammar.evaluate(b) == 0:
            b = [("number", Fraction(1), ())]
        shift = [(k, v, tuple(x + len(a) for x in c)) for k, v, c in b]
        return [*a, *shift, (op, None, (len(a) - 1, len(a) + len(b) - 1))]

    for _ in range(1000):
        nodes = tree(5)
        value = grammar.evaluate(nodes)
        resolved = calculation.Provenance("", []).resolve(nodes)
        assert calculation.run_graph(resolved, []) == value == calculation.run_program(calculation.compile_step(resolved), [], [])
        assert calculation.graph_signatures(resolved) == calculation.program_signatures(calculation.compile_step(resolved))
        assert grammar.evaluate(grammar.fold_signs(nodes)) == value
