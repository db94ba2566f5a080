from pyspark.sql import functions as F

from quern.functions import arith, boxed, symbolic, text


def test_norm_exact_and_tokens(col):
    assert col(text.norm_exact, ["A-b C!", None]) == ["abc", ""]
    assert col(text.tokens, ["It's 2 x", None]) == [["it", "s", "2", "x"], []]


def test_ngrams(col):
    assert col(lambda c: text.ngrams(text.tokens(c), 2), ["a b c", "a", None]) == [["a b", "b c"], [], []]
    assert col(lambda c: text.ngrams(text.tokens(c), 13), [" ".join("abcdefghijkl")]) == [[]]


def test_strict_and_flexible_answers(col):
    assert col(text.extract_strict, ["r\n#### 42", "#### 1,234", "#### $42", "#### 1 #### 2", "x"]) == ["42", "1234", None, "2", None]
    assert col(text.extract_flexible, ["I got 42 apples, done", "a . b .", "the answer is 42", "none"]) == [",", ".", "42", None]
    assert col(text.normalize_number, [" 1,234. ", "$5", ",", None]) == ["1234", "5", "", None]


def test_answer_normal_form(col):
    assert col(text.normalize_answer, ["\\leftarrow", " \\dfrac12 ", "$ 3$\n", "\\left( 1 \\right)"]) == ["arrow", "\\frac12", "3", "( 1 )"]


def test_last_box(col):
    cases = ["\\boxed{1} then \\boxed 2", "\\boxed{\\boxed{3}}", "\\boxed{1", "\\boxed  {7}", "none", "\\boxed{\\frac{1}{2}}", "\\boxed{}", None]
    assert col(boxed.last_boxed, cases) == [None, "3", None, "7", None, "\\frac{1}{2}", "", None]


def test_last_box_agrees_with_a_scan(col):
    import random

    random.seed(1)
    cases = ["".join(random.choice(["\\boxed", "{", "}", "x", " "]) for _ in range(random.randint(0, 12))) for _ in range(300)]

    def scan(t):
        if "\\boxed" not in t:
            return None
        rest = t.rsplit("\\boxed", 1)[1].lstrip(" ")
        if not rest.startswith("{"):
            return None
        depth = 0
        for i, c in enumerate(rest):
            depth += (c == "{") - (c == "}")
            if depth == 0:
                return rest[1:i]
        return None

    assert col(boxed.last_boxed, cases) == [scan(t) for t in cases]


def test_all_boxes():
    assert boxed.boxes("\\boxed{\\boxed{3}}") == ["\\boxed{3}"]
    assert boxed.boxes("\\boxed{1") == ["1"]
    assert boxed.boxes("\\boxed x \\boxed {a} \\boxed{b}") == ["a", "b"]
    assert boxed.boxes(None) == []


def test_ground_truth(col):
    b = lambda x: f"\\boxed{{{x}}}"
    got = col(boxed.ground_truth, ["none", b(1) + b(2), b(""), b("x" * 101), b("\\dfrac12") + b("\\frac12")])
    assert [(g.answer, g.reason) for g in got] == [(None, "no_boxed"), (None, "multi_boxed"), (None, "empty"), (None, "too_long"), ("\\frac12", "ok")]


def test_arithmetic():
    good = {"3 * 8": 24, "1+2*3": 7, "(1+2)*3": 9, "-2--3": 1, "7/2": 3.5, "0+00": 0, "+4": 4}
    assert {t: arith.evaluate(t) for t in good} == good
    for bad in ("2**3", "(3)(8)", "08+1", "3/0", "", "()", "7//2", "1 2", "(1", "a", None):
        assert arith.evaluate(bad) is None


def test_symbolic_normal_forms(col):
    pairs = [("\\dfrac{1}{2}", "\\frac12"), ("0.5", "\\frac{1}{2}"), ("x=5", "5"), ("1/2", "\\frac{1}{2}"), (".5", "0.5"), ("\\left(1, 2\\right)", "(1,2)"), ("50\\%", "50"), ("\\sqrt3", "\\sqrt{3}")]
    a, b = zip(*pairs, strict=True)
    assert col(symbolic.normal_form, a) == col(symbolic.normal_form, b)
    assert col(lambda c: symbolic.equivalent(c, F.lit("4")), ["4", "5", None]) == [True, False, False]
