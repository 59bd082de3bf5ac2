"""Hand-written rows, above all the pinned behaviours."""

import pytest
from pyspark.sql import functions as F

from corpuswright.functions import arrays as A
from corpuswright.functions import mt_tokens as M
from corpuswright.functions.text import py_split, py_strip
from corpuswright.operators import denoise as U
from corpuswright.operators import directions as D
from corpuswright.operators import evaluate as E
from corpuswright.operators import filters as R
from corpuswright.operators import losses as L
from corpuswright.operators import outputs as O
from corpuswright.operators import preference as P
from corpuswright.operators import prompts as PR
from corpuswright.operators import tokens as T
from corpuswright.operators.vocab import Specials, vocabulary_of
from corpuswright.sources import lang as LG


def one(spark, col, **values):
    """The value of a column expression over one row of literals."""
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (0,)
    return spark.createDataFrame([row], schema).select(col.alias("v")).first()["v"]


def ids(v):
    return ("array<int>", v)


def test_py_strip_matches_python(spark):
    for s in ["", "  ", "　a b ", "\x1c\x85x ", "​keep", "\ta\nb\r\n", "é "]:
        assert one(spark, py_strip(F.col("s")), s=("string", s)) == s.strip()
        assert one(spark, py_split(F.col("s")), s=("string", s)) == s.split()


def test_lang_dim(spark):
    rows = {r.lang: r for r in LG.lang_dim(spark).collect()}
    assert len(rows) == 50 and rows["en"].group_id is None
    assert (rows["zh"].name, rows["zh"].nllb, rows["zh"].iso3, rows["zh"].group_id) == ("Chinese", "zho_Hans", "zho", 6)
    groups = [r.group_id for r in rows.values() if r.group_id]
    assert sorted(set(groups)) == list(range(1, 9)) and len(groups) == 49
    with pytest.raises(Exception, match="no group_id for en"):
        LG.lang_group(spark.createDataFrame([("en",)], "lang string"), "lang").collect()


def test_direction_requests():
    assert D.canonical("en-de") == "de-en" and D.canonical("de-en") == "de-en"
    assert D.requested_languages("de-en,en-fr") == ["de", "en", "fr"]
    assert R.iso3_codes("de-en") == ["deu", "eng"]
    with pytest.raises(ValueError):
        D.parse_directions("deen")


def test_expand_zero_one_two(spark):
    rows = spark.createDataFrame(
        [(1, "de", "en", "a", "b"), (2, "fr", "en", "c", "d"), (3, "cs", "en", "e", "f")],
        "seq int, lang_a string, lang_b string, text_a string, text_b string",
    )
    got = D.expand_directions(rows, "en-de,de-en,en-fr").orderBy("seq", "ord").collect()
    assert [(r.seq, r.ord, r.direction, r.src_text, r.tgt_text) for r in got] == [
        (1, 0, "de-en", "a", "b"), (1, 1, "en-de", "b", "a"), (2, 1, "en-fr", "d", "c"),
    ]


def example(spark, src="en", tgt="de"):
    return spark.createDataFrame(
        [(1, src, tgt, f"{src}-{tgt}", "Hi", "Hallo")],
        "seq int, src string, tgt string, direction string, src_text string, tgt_text string",
    )


def test_prompts(spark):
    assert PR.render_prompt(example(spark)).first().prompt == (
        "Translate this from English to German:\nEnglish: Hi\nGerman:"
    )
    assert PR.render_prompt_local(example(spark)).first().prompt == (
        "Übersetzen Sie dies vom Englischen ins Deutsche:\nEnglisch: Hi\nDeutsch:"
    )
    english = PR.render_prompt_local(example(spark, "de", "en")).first().prompt
    assert english == "Translate this from German to English:\nGerman: Hi\nEnglish:"
    with pytest.raises(Exception, match="no localized prompt for pl"):
        PR.render_prompt_local(example(spark, "en", "pl")).collect()
    shots = spark.createDataFrame([("en-de", [("a", "b"), ("c", "d")])], "direction string, shots array<struct<source:string,target:string>>")
    assert PR.render_few_shot(example(spark), shots).first().prompt == (
        "Translate this from English to German:\nEnglish: a\nGerman: b\nEnglish: c\nGerman: d\nEnglish: Hi\nGerman:"
    )
    with pytest.raises(Exception, match="no shots for de-en"):
        PR.render_few_shot(example(spark, "de", "en"), shots).collect()
    assert PR.render_encdec(example(spark), "instruct").first().prompt == "Translate to German: Hi"
    with pytest.raises(ValueError):
        PR.render_encdec(example(spark), "other")
    assert PR.answer_suffix(example(spark), chat_suffix=" [/INST]").first().suffix == "\nGerman: [/INST]"


def test_empty_and_blank_sides(spark):
    rows = spark.createDataFrame([("",), (" ",), ("a",)], "text string")
    assert [r.text for r in R.drop_empty_sides(rows).collect()] == [" ", "a"]


def test_required_direction(spark):
    rows = spark.createDataFrame([(None, "de"), ("", "de"), ("en-de", "de"), ("en-de", "en")], "required_direction string, tgt string")
    assert R.filter_required_direction(rows).count() == 3


def test_prompt_length_modes(spark):
    rows = spark.createDataFrame([([1] * n,) for n in (3, 4, 5)], "ids array<int>")
    counts = {m: R.filter_prompt_len(rows, "ids", 4, m).count() for m in ("reference", "untruncated", "strict")}
    assert counts == {"reference": 3, "untruncated": 2, "strict": 1}


def test_eos_and_padding(spark):
    c = F.col("ids")
    assert one(spark, A.append_eos(c, 2), ids=ids([1, 5])) == [1, 5, 2]
    assert one(spark, A.append_eos(c, 2), ids=ids([1, 2])) == [1, 2]
    assert one(spark, A.append_eos(c, 2), ids=ids([])) == [2]
    assert one(spark, A.pad_to(c, 4, 0, "left"), ids=ids([1, 5])) == [0, 0, 1, 5]
    assert one(spark, A.pad_to(c, 1, 0), ids=ids([1, 5])) == [1, 5]
    assert one(spark, A.pad_mask(c, 4, "left"), ids=ids([1, 5])) == [0, 0, 1, 1]
    # right-padded: first pad, or the last position of a full row
    put = lambda x: A.put_at(x, A.eos_slot(x, 0), 2)
    assert one(spark, put(c), ids=ids([1, 5, 0, 0])) == [1, 5, 2, 0]
    assert one(spark, put(c), ids=ids([1, 5, 6])) == [1, 5, 2]


def test_first_index(spark):
    c = F.col("ids")
    assert one(spark, A.first_index(c, 0), ids=ids([4, 0, 0])) == 1
    assert one(spark, A.first_index(c, 0), ids=ids([4])) == -1
    assert one(spark, A.first_index_not(c, -100), ids=ids([-100, -100, 7])) == 2


def test_labels(spark):
    c = F.col("ids")
    # pad = eos: the real end is ignored as well
    assert one(spark, A.ignore_value(c, 2), ids=ids([1, 5, 2, 2])) == [1, 5, -100, -100]
    assert one(spark, A.ignore_span(c, F.lit(1), F.lit(2)), ids=ids([9, 8, 7, 6])) == [9, -100, -100, 6]
    assert one(spark, A.shift_right(c, 1, 0), ids=ids([5, -100, 6])) == [1, 5, 0]
    assert one(spark, A.shift_right_mask(c, 1), ids=ids([5, -100, 6])) == [1, 1, 0]


def test_train_chains(spark):
    v = vocabulary_of(spark, ["a", "b", "c"])
    assert len(v) == 7
    rows = spark.createDataFrame([("a b", "a b c")], "prompt string, full_text string")
    left = T.encode_train_left(rows, v, 4, 4, ignore_prompt=True).first()
    assert left.input_ids == [0, 0, 0, 1, 4, 5, 6, 2]
    assert left.attention_mask == [0, 0, 0, 1, 1, 1, 1, 1]
    # the prompt is counted without BOS, so its last token keeps its label
    assert left.labels == [-100, -100, -100, -100, -100, 5, 6, 2]
    right = T.encode_train_right(rows, v, 3, 3).first()
    assert right.input_ids == [1, 4, 5, 6, 2, 0]
    assert right.labels == [-100, -100, 5, 6, 2, -100]
    assert right.prefix_mask == [1, 1, 0, 0, 0, 0]
    with pytest.raises(ValueError):
        T.encode_train_right(rows, v, ignore_prompt=False)
    test = T.encode_test(rows, v, 4, prefix_lm=True).first()
    assert (test.input_ids, test.prefix_mask) == ([0, 1, 4, 5], [0, 1, 1, 1])


def test_decode(spark):
    v = vocabulary_of(spark, ["a", "b"])
    assert one(spark, v.decode(F.col("ids")), ids=ids([1, 4, -100, 5, 2, 0])) == "a b"


def test_pad_equal_to_eos(spark):
    s = Specials(pad=2, bos=1, eos=2, unk=0)
    v = vocabulary_of(spark, ["a"], s)
    rows = spark.createDataFrame([("a", "a a")], "prompt string, full_text string")
    assert T.encode_train_left(rows, v, 3, 3).first().labels == [-100, -100, 1, 3, 3, -100]


def test_denoise_without_pad(spark):
    row = ids([11, 12, 13, 14, 15, 16, 17, 18])
    mask = U.x_mask(F.size("ids"), F.lit(-1), 42, F.lit(7))
    # one span over the second half, the last position cleared
    assert one(spark, mask, ids=row) == [0, 0, 0, 0, 1, 1, 1, 0]
    assert one(spark, U.s_prefix(F.size("ids"), F.lit(-1)), ids=row) == [1, 1, 0, 0, 0, 0, 0, 0]
    assert one(spark, U.s_prefix(F.size("ids"), F.lit(7)), ids=row) == [1, 1, 1, 0, 0, 0, 0, 0]


def test_sentinels(spark):
    m = ids([1, 1, 0, 1, 0, 0, 1, 1])
    assert one(spark, U.sentinels(F.col("ids"), 100), ids=m) == [99, -1, 0, 98, 0, 0, 97, -1]
    marks = U.sentinels(F.col("m"), 100)
    got = one(spark, U.apply_sentinels(F.col("ids"), marks, 0), ids=ids([5, 6, 7, 8, 9, 10, 11, 12]), m=m)
    assert got == [99, 7, 98, 9, 10, 97, 0, 0]


def test_left_padded_rows_are_not_corrupted(spark):
    rows = spark.createDataFrame([(1, [0, 0, 5, 6], [0, 0, 1, 1], [-100, -100, 5, 6])], "k int, input_ids array<int>, attention_mask array<int>, labels array<int>")
    got = U.r_denoise(rows, "k", 42, 100).first()
    # nothing is masked; the target is one sentinel for everything that was kept
    assert got.input_ids == [5, 6, 99, 0] and got.labels == [-100, -100, 99, -100]


PAIR = "texts array<string>, scores array<double>, delta int"


@pytest.mark.parametrize(
    "scores, delta, want",
    [
        ([0.1, 0.5, 0.9], None, ("t2", "t0")),
        ([0.5, 0.5, 0.5], 0, ("t0", "t0")),
        ([0.5, 0.9, 0.9], None, ("t1", "t0")),
        ([0.9, 0.5, 0.5], None, ("t0", "t1")),
        ([0.9, 0.5, 0.5], 1, ("t1", "t2")),
        ([0.9, 0.5, 0.5], -2, ("t2", "t1")),
    ],
)
def test_choose_pair(spark, scores, delta, want):
    row = P.choose_pair(spark.createDataFrame([(["t0", "t1", "t2"], scores, delta)], PAIR)).first()
    assert (row.chosen, row.rejected) == want


def test_bad_scores_are_refused(spark):
    for bad in ([0.1, None, 0.2], [0.1, float("nan"), 0.2]):
        with pytest.raises(Exception, match="NULL or NaN"):
            P.require_scores(spark.createDataFrame([(["a", "b", "c"], bad, 0)], PAIR)).collect()


def test_merged_prompt_token(spark):
    # 'x:' and 'y' merge to one word, so the prompt ends one token earlier
    v = vocabulary_of(spark, ["a", "x:", "x:y", "z"])
    got = one(spark, P.split_answer(v, F.col("p"), F.col("q")), p=("string", "a x:"), q=("string", "y z"))
    assert (got.prompt_ids, got.answer_ids) == ([4], [6, 7])
    got = one(spark, P.split_answer(v, F.col("p"), F.col("q")), p=("string", "a x:"), q=("string", " z"))
    assert (got.prompt_ids, got.answer_ids) == ([4, 5], [7])


def test_encode_preference_truncation(spark):
    v = vocabulary_of(spark, list("abcdefgh"))
    rows = spark.createDataFrame([("a b c d", " e f g", " h")], "prompt string, chosen string, rejected string")
    end = P.encode_preference(rows, v, 6, 2, "keep_end").first()
    assert end.chosen_input_ids == [6, 7, 8, 9, 10, 2] and end.chosen_labels == [-100, -100, 8, 9, 10, 2]
    assert end.rejected_input_ids == [6, 7, 11, 2] and end.prompt_input_ids == [6, 7]
    start = P.encode_preference(rows, v, 5, 2, "keep_start").first()
    assert start.chosen_input_ids == [1, 4, 8, 9, 10]
    with pytest.raises(ValueError):
        P.encode_preference(rows, v, mode="middle")
    pairs = P.stack_pairs(P.encode_preference(rows, v).withColumn("b", F.lit(1)), "b").orderBy("side").collect()
    assert pairs[1].input_ids == [1, 4, 5, 6, 7, 11, 2, 0, 0] and pairs[1].labels[-3:] == [2, -100, -100]


def margin(spark, lp_c, n_c, lp_r, n_r):
    return spark.createDataFrame([(lp_c, n_c, lp_r, n_r)], "chosen_logp double, chosen_tokens long, rejected_logp double, rejected_tokens long")


def test_adaptive_penalty(spark):
    row = L.adaptive_penalty(margin(spark, -4.0, 4, -4.0, 4)).first()
    assert row.penalty == pytest.approx(-0.1) and row.margin == pytest.approx(-4.4)
    assert L.adaptive_penalty(margin(spark, -4.0, 4, -40.0, 4)).first().penalty == 1.0
    assert L.adaptive_penalty(margin(spark, -4.0, 4, -5.0, 4), penalty=1).first().margin == pytest.approx(1.0)


def test_losses(spark):
    import math

    rows = spark.createDataFrame([(3.0,), (-2000.0,)], "margin double")
    for kind, f in {
        "sigmoid": lambda m: -math.log(1 / (1 + math.exp(-0.1 * m))),
        "hinge": lambda m: max(0.0, 1 - 0.1 * m),
        "ipo": lambda m: (m - 5.0) ** 2,
        "simpo": lambda m: -math.log(1 / (1 + math.exp(-0.1 * (m - 5.0)))),
    }.items():
        got = [r.loss for r in L.preference_loss(rows, kind).collect()]
        assert got == pytest.approx([f(3.0), f(-2000.0)])
    with pytest.raises(ValueError):
        L.preference_loss(rows, "other")


def test_token_logp(spark):
    import math

    want = 2.0 - math.log(sum(math.exp(x) for x in (1.0, 2.0, 3.0)))
    assert one(spark, L.token_logp(F.col("x"), F.lit(1)), x=("array<float>", [1.0, 2.0, 3.0])) == pytest.approx(want)
    big = one(spark, L.token_logp(F.col("x"), F.lit(0)), x=("array<float>", [1000.0, 0.0]))
    assert big == pytest.approx(0.0)


def test_all_labels_ignored(spark):
    rows = spark.createDataFrame([(1, p, [0.0, 1.0], -100) for p in range(3)], "seq int, pos int, logits array<float>, label int")
    tokens = L.token_table(rows, ["seq"])
    assert L.sequence_logp(tokens, ["seq"]).first().logp == 0.0
    assert L.non_pad_count(tokens, ["seq"]).first().n_tokens == 0


def test_policy_continuation(spark):
    rows = spark.createDataFrame([("a😀:", "a😀: b")], "prompt string, output string")
    assert L.policy_sample_table(rows).first().policy == " b"


def python_clean(output, key, k):
    """Brute force of the cleaning rules."""
    try:
        lines = output.split(key)[k].split("\n")
        for i in (0, 1):
            if lines[i].strip():
                return lines[i].strip()
        return lines[2].strip()
    except IndexError:
        pass
    try:
        return output.split(key)[2].split("\n")[0].strip()
    except IndexError:
        return ""


OUTPUTS = [
    "", "no suffix", "p\nEnglish: a", "p\nEnglish:\n b \nc", "p\nEnglish: \n \n", "p\nEnglish: \n \nthird",
    "p\nEnglish:", "p\nEnglish:\nEnglish: x\ny", "p\nEnglish:\n", "p\nEnglish: a\nEnglish: b\nEnglish: c", "p\nEnglish:\nEnglish:",
]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_clean_output(spark, k):
    rows = spark.createDataFrame([(i, o) for i, o in enumerate(OUTPUTS)], "i int, o string")
    got = rows.select("i", O.clean_output(F.col("o"), F.lit("\nEnglish:"), k).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [python_clean(o, "\nEnglish:", k) for o in OUTPUTS]


def test_suffix_is_literal(spark):
    assert one(spark, O.clean_output(F.col("o"), F.lit("\n(a.b)")), o=("string", "x\n(aXb) no\n(a.b) yes")) == "yes"


def test_split_qa(spark):
    qa = lambda o, p, s: tuple(one(spark, O.split_qa(F.col("o"), p, s), o=("string", o)))
    assert qa("[I] q [/I] r [/I] t", "[I]", " [/I]") == ("q", "r", False)
    assert qa(" whole ", "", "") == ("", "whole", False)
    assert qa("no affix", "[I]", "[/I]") == ("no affix", "TODO", True)
    assert qa("q [/I] r", "", " [/I]") == ("q [/I] r", "TODO", True)
    assert qa("[I] q", "[I]", "") == ("[I] q", "TODO", True)


def test_tokenizers(spark):
    tok = lambda s: one(spark, M.tokenize_13a(F.col("s")), s=("string", s))
    assert tok('He said, "1,000.5 is-a 3-4" &amp; left.') == [
        "He", "said", ",", '"', "1,000.5", "is-a", "3", "-", "4", '"', "&", "left", ".",
    ]
    zh = one(spark, M.tokenize_zh(F.col("s")), s=("string", " 我爱GPT 3.5。"))
    assert zh == ["我", "爱", "GPT", "3.5", "。"]


def aligned_rows(spark, rows):
    return spark.createDataFrame(
        [("s", d, i, "src", ref, hyp) for i, (d, ref, hyp) in enumerate(rows)],
        "system string, direction string, seg_id long, source string, reference string, hypothesis string",
    )


def test_bleu_extremes(spark):
    same = "the cat sat on the mat"
    score = lambda rows: [r.bleu for r in E.bleu(aligned_rows(spark, rows)).collect()]
    assert score([("de-en", same, same)]) == [100.0]
    assert score([("de-en", same, "nothing alike at all here")]) == [0.0]
    assert score([("de-en", same, "")]) == [0.0]
    assert score([("de-en", same, "the cat")]) == [0.0]
    assert score([("en-ja", same, same)]) == []
    # a missing output is an empty one: the brevity penalty sees it
    both = score([("de-en", same, same), ("de-en", same, None)])
    assert both == score([("de-en", same, same), ("de-en", same, "")]) and 0 < both[0] < 60
    # a line without a reference is no segment
    assert score([("de-en", same, same), ("de-en", None, "more")]) == [100.0]


def test_audit_reports_gaps(spark):
    line = lambda rows: spark.createDataFrame(rows, "direction string, seg_id long, text string")
    src = line([("a-b", 0, "x"), ("a-b", 1, "y"), ("c-d", 0, "z")])
    ref = line([("a-b", 0, "x"), ("a-b", 1, "y")])
    out = spark.createDataFrame([("s", "a-b", 0, " ")], "system string, direction string, seg_id long, text string")
    got = {r.direction: r for r in E.alignment_audit(src, ref, out, ["s"]).collect()}
    assert (got["a-b"].output_lines, got["a-b"].missing_output, got["a-b"].blank_outputs) == (1, 1, 1)
    assert (got["c-d"].missing_reference, got["c-d"].output_lines, got["c-d"].missing_output) == (1, 0, 1)
