from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lodestack.functions import numbers as N
from lodestack.functions import tables as H
from lodestack.functions import text as T


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "want"), [
    ("15,000 most", [15000.0]), ("v2.3 is", [2.3]), (r"$8.5 \times 10^{11}$", [8.5e11]), ("7,5", [7.5]), ("3.6w", [36000.0]), ("3.6e4", [36000.0]), ("36 million", [36e6]), ("F1 百分点", [1.0]),
    ("2亿", [2e8]), ("三万六千", [36000.0]), ("十二点五", [12.5]), ("三", []), ("0.81 between", [0.81]), ("2.7 kernels", [2.7]), ("32k", [32000.0]), ("10²", [102.0]), ("", []), (None, []), ("24e6399999", [24.0]),
])
def test_scan(text, want):
    assert [v for _, _, _, v, _ in N.scan(text)] == pytest.approx(want)


def test_percent_and_spans():
    got = N.scan(r"rose 54$\%$ to 12 percent of 7%")
    assert [(r, p) for r, _, _, _, p in got] == [("54", True), ("12 percent", True), ("7", True)]


def test_years_only_in_context():
    assert N.significant("in 2019 we saw 2019 cats [12]") == [2019.0]
    assert N.significant("since 2019") == []
    assert N.significant("2018年 的 5 只") == []


def test_derivable(spark):
    for value, operands, want in ((1700.0, [2000.0, 300.0], True), (6.67, [2000.0, 300.0], True), (0.069, [293.0, 4262.0], True), (999.0, [2000.0, 300.0], False), (5.0, [5.0], False), (3.0, [0.0, 3.5], False)):
        got = spark.createDataFrame([(value, operands)], "v double, o array<double>").select(N.derivable(F.col("v"), F.col("o"))).first()[0]
        assert got is want, (value, operands)


def test_parsed(spark):
    got = [r[0] for r in spark.createDataFrame([("1,234",), ("7,5",), ("45%",), ("abc",), ("3 or 4",), (None,)], "s string").select(N.parsed(F.col("s"))).collect()]
    assert got == [1234.0, 7.5, 45.0, None, None, None]


def test_evidence_states(spark):
    state = lambda q, t: one(spark, T.evidence_state(F.col("q"), F.col("t")), q=q, t=t)
    text = "The “large” model—as said—wins by 3.5 points, and the small one loses."
    assert state('the "large" model-as', text) == "hit"
    assert state("wins by 35 points", text) == "hit"  # signs aside
    assert state("the “large” model … small one loses", text) == "loose"
    assert state("the medium model", text) == "miss"
    assert state("", text) == "miss" and state(None, text) == "miss" and state("x", None) == "miss"


def test_anchor_lists(spark):
    d = spark.createDataFrame([("A **bold** 3.5 % gain",)], "t string")
    empty = F.array().cast("array<string>")
    got = d.select(T.hit_all(empty, F.col("t")), T.hit_any(empty, F.col("t")), T.hit_all(F.array(F.lit("bold 3.5"), F.lit("3.5%")), F.col("t")), T.keyword_verdict(F.col("t"), empty, empty, F.array(F.lit("gain")))).first()
    assert tuple(got) == (True, True, True, False)


@pytest.mark.parametrize(("raw", "want"), [("[1, 2]", [1, 2]), ("3", [3]), ("4, 5", [4, 5]), ("x", None)])
def test_as_list(spark, raw, want):
    assert one(spark, T.as_list(F.col("s")), s=raw) == want


@pytest.mark.parametrize(("raw", "want"), [('{"a": 1}', '{"a":1}'), ('so ```json\n{"a": 2}\n``` done', '{"a":2}'), ('text {"a": {"b": 3}} end', '{"a":{"b":3}}'), ("nothing", None)])
def test_json_object(spark, raw, want):
    assert one(spark, T.json_object(F.col("s")), s=raw) == want


def test_ranking(spark):
    assert one(spark, T.ranking(F.col("s"), 4), s="first [3, 3, 9, 1] then") == [3, 1, 2, 4]
    assert one(spark, T.ranking(F.col("s"), 3), s="none") == [1, 2, 3]
    assert one(spark, T.ranking(F.col("s"), 4, complete=False), s="[2]") == [2]


def test_bad_date_raises(spark):
    with pytest.raises(Exception, match="not a date"):
        one(spark, T.coarse_day(F.col("s")), s="soon")
    assert one(spark, T.coarse_day(F.col("s")), s="1970-01-03") == 2


def test_table_grid():
    html = "<table><tr><th rowspan=2>Model</th><th colspan='2'>Story</th></tr><tr><th>Acc</th><th>F1</th></tr><tr><td>a|b</td><td>1</td><td>2</td></tr><tr><td></td><td></td><td></td></tr></table>"
    grid, head = H.table_grid(html)
    assert grid[:2] == [["Model", "Story", "Story"], ["Model", "Acc", "F1"]] and head == 2
    assert H.table_markdown(html) == "| Model | Story/Acc | Story/F1 |\n|---|---|---|\n| a\\|b | 1 | 2 |"
    assert H.table_markdown(None) == "" and H.table_markdown("plain <b>x</b>") == "plain x"


def test_rowspan_into_data():
    grid, head = H.table_grid("<table><tr><td>k</td><td>v</td></tr><tr><td rowspan=2>x</td><td>1</td></tr><tr><td>2</td></tr></table>")
    assert grid == [["k", "v"], ["x", "1"], ["x", "2"]] and head == 1


@pytest.mark.parametrize(("raw", "want"), [(r"$\mathrm { R N N }$", "RNN"), (r"S o f t m a x", "Softmax"), ("x i t", "x i t"), (r"\begin{array}{rl} \alpha _ { k } \end{array}", "alpha k"), (None, "")])
def test_latex(spark, raw, want):
    assert one(spark, H.latex_words(F.col("s")), s=raw) == want


def test_captions_and_headers(spark):
    assert one(spark, H.clean_captions(F.col("c")), c=["Figure 6: x", "y Table IV Comparison", "Age Race"]) == ["Table IV Comparison"]
    assert one(spark, H.header_cells(F.col("s")), s="cap\n| a | b | a |\n|--|--|") == ["a", "b"]
    assert one(spark, H.header_cells(F.col("s")), s="no table") == []
    assert one(spark, H.masked_rows(F.col("s")), s="a\n| b |\nc") == "a\n\nc"
    assert one(spark, H.without_scripts(F.col("s"), keep=False), s="x<sup>2</sup><i>y</i>") == "xy"


@pytest.mark.parametrize(("text", "want"), [("doña ana pays", True), ("isé", True), ("island", False), ("so 是吗", True), ("so 是吗\n", False)])
def test_verdict_questions_end_words_at_ascii_letters_only(spark, text, want):
    assert one(spark, T.asks_verdict(F.col("q")), q=text) is want


def test_acronyms_end_at_letters_with_accents(spark):
    f = T.surface_features(F.col("q"))
    got = {c: one(spark, f[c], q="the éNLP and BERTé for camelCaseé; a\x0bb") for c in ("n_acronyms", "n_words")}
    assert got == {"n_acronyms": 2, "n_words": 7}


def test_verdict_sentences_end_at_letters_with_accents(spark):
    from lodestack.operators import verification as V

    assert one(spark, V.masked_verdicts(F.col("a")), a="Noé came. No, never. Nothing.") == "Nothing."


def test_views_of_a_text_are_made_once_for_all_anchors(spark):
    """Made for each anchor they would take minutes here."""
    import time

    rows = spark.createDataFrame([("*so* it goes " * 30_000,)], "t string").withColumn("a", F.transform(F.sequence(F.lit(1), F.lit(1_500)), lambda i: F.concat(F.lit("z"), i.cast("string"))))
    begun = time.monotonic()
    got = rows.select(F.size(T.missing(F.col("a"), F.col("t"))).alias("n"), T.hit_any(F.col("a"), F.col("t")).alias("any"), T.hit_all(F.array(F.lit("so it")), F.col("t")).alias("all")).first()
    assert tuple(got) == (1_500, False, True)
    assert time.monotonic() - begun < 15


def test_number_scan_and_formula_words_take_time_in_proportion_to_the_text():
    import time

    begun = time.process_time()
    assert N.scan("é 5² " * 10 + "naïve " * 500_000)[0][3] == 52.0 and not N.scan("naïve " * 2_000_000)
    assert len(H.formula_words(r"\mathrm { a b } x " * 20_000).split()) == 60_000
    assert time.process_time() - begun < 3


_PIECE = re.compile(r"\\[A-Za-z]+|\\.|[{}]|[$&_^\\]|\s+|[^\\{}$&_^\s]+", re.S)


def _by_pieces(latex):
    """The words of a formula, piece by piece."""
    words, letters, skipping, depth = [], [], False, 0
    for piece in [*_PIECE.findall(latex), "$"]:
        if skipping and (depth or piece == "{" or piece.isspace()):
            depth += (piece == "{") - (piece == "}")
            continue
        command = piece[1:] if piece[0] == "\\" else ""
        skipping = command in H.ENVIRONMENT
        word = command or piece
        if skipping or command in H.WRAPPERS | H.SILENT or word in tuple("{}$&_^\\"):
            word = ""
        if len(word) == 1 and word.isascii() and word.isalpha():
            letters.append(word)
        elif word.strip() or piece not in "{}" and not piece.isspace():
            one = "".join(letters)
            sure = len(letters) > 1 and (one.isupper() or len(letters) > 4 and one[0].isupper() and one[1:].islower())
            words += [*([one] if sure else letters), *[word] * bool(word.strip())]
            letters = []
    return " ".join(words)


def test_formulas_by_passes_are_those_by_pieces():
    some = random.Random(4)
    parts = r"\ \\ { } { } $ & _ ^ a b A B x é 中 1 , ab Softmax \begin \end \begin{array} \begin{a{b}c} \left \quad \alpha \mathrm{ \a \B \, \1 \é \beginx \lefty \bigl \$ \{ \} 😀 \😀".split(" ") + [" ", "\n", " ", "\x1c", "\\ ", "\\\n", "S o f t m a x", "R N N"]
    for _ in range(20_000):
        latex = "".join(some.choice(parts) + some.choice(("", "", " ")) for _ in range(some.randint(0, 16)))
        assert H.formula_words(latex) == _by_pieces(latex), latex


def test_formulas_take_less_time_than_a_walk_over_their_pieces():
    latex = r"\mathrm { T H E } \alpha _ { cat } $sat$ \begin{array} {l}on\left ^ {2} \end {array} \operatorname { T h e r e } \quad " * 4_000

    def least(work):
        took = []
        for _ in range(5):
            began = time.perf_counter()
            work()
            took.append(time.perf_counter() - began)
        return min(took)

    def walk():
        for m in _PIECE.finditer(latex):
            m[0]

    assert H.formula_words(latex) == " ".join(["THE alpha cat sat on 2 There"] * 4_000)
    assert least(lambda: H.formula_words(latex)) < least(walk)
