"""Operators on single texts, against plain versions and the tokenizers library."""

import math
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from planlens.llm import chat_format, queries, record_files, robust_outliers, rule_ensemble, word_bpe

SMALL = "/root/testdata/sf0.001"
WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
LETTERS = st.text(
    st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from(" \n\t'sStaab.,!?\x1c\x85　中Σς١½²é́ẞ😀")), max_size=60
)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(LETTERS, st.sampled_from(["<|endoftext|>", "a<|endoftext|>b 's", "aaaaaaa", "\n\n  x", "\nx y"])), max_size=5))
def test_encoders_agree_with_the_library(texts):
    library = Tokenizer.from_file(WORD)
    ids, starts = word_bpe.load(WORD).encode(texts)
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == expected
    assert word_bpe.load(WORD).decode(ids, starts) == [library.decode(e, skip_special_tokens=False) for e in expected]
    library = Tokenizer.from_file(BYTE)
    assert [x.tolist() for x in record_files.load(BYTE).encode(texts)] == [
        library.encode(t, add_special_tokens=False).ids for t in texts
    ]


def test_word_bpe_query(spark, documents):
    library = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in queries.op4_word_bpe(spark, SMALL).collect()}
    for row in documents.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        out = got.pop(row.doc_id)
        assert out.n_tokens == len(ids) and out.ids_sha256 == brute.sha(" ".join(map(str, ids)))
        assert out.decoded_sha256 == brute.sha(library.decode(ids, skip_special_tokens=False))
    assert not got


def test_word_bpe_awkward(awkward, empty):
    library = Tokenizer.from_file(WORD)
    rows = word_bpe.encode_decode(awkward, WORD, "doc_id", "text", "size").collect()
    assert len(rows) == awkward.count()
    assert all(r.ids == library.encode(r.text or "", add_special_tokens=False).ids for r in rows)
    assert word_bpe.encode_decode(empty, WORD, "doc_id").count() == 0


def test_record_files_query(spark, documents):
    library, start = Tokenizer.from_file(BYTE), 0
    got = {r.doc_id: r for r in queries.op9_record_files(spark, SMALL).collect()}
    for row in documents.orderBy("doc_id").collect():
        ids = [*library.encode(row.text or "", add_special_tokens=False).ids, queries.END_ID]
        crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert (got[row.doc_id].start, got[row.doc_id].n_tokens, got[row.doc_id].ids_crc32) == (start, len(ids), crc)
        start += len(ids)


def test_record_files_shuffled_damage_and_awkward(spark, awkward, empty, tmp_path):
    folder = f"{tmp_path}/a"
    index = record_files.write_records(awkward, folder, BYTE, 2)
    in_order = record_files.read_records(index, folder).collect()
    assert len(in_order) == awkward.count() == index.count()
    plain = sorted((str(r.doc_id), r.ids) for r in in_order)
    for seed in (1, 2):
        assert sorted((str(r.doc_id), r.ids) for r in record_files.read_shuffled(index, folder, seed, 3).collect()) == plain
    summed = record_files.read_with_starts(index, folder).collect()
    assert sum(r.n_tokens for r in summed) == max(r.start + r.n_tokens for r in summed)
    assert record_files.read_with_starts(record_files.write_records(empty, f"{tmp_path}/b", BYTE, 2), f"{tmp_path}/b").count() == 0
    file = index.orderBy("offset", ascending=False).first().file
    data = bytearray(open(f"{folder}/{file}", "rb").read())
    data[-6] ^= 1
    open(f"{folder}/{file}", "wb").write(data)
    with pytest.raises(Exception, match="damaged"):
        record_files.read_records(index, folder).collect()


def test_record_files_cut_rows_that_share_an_id(spark, tmp_path):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i}") for i in range(900)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        index = record_files.write_records(docs, f"{tmp_path}/even", BYTE, 2).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = sorted(Counter(r.shard for r in index).values())
    assert sum(sizes) == 900 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert len({r.shard for r in index if r.doc_id is None}) > 1
    ids = [r.doc_id or 0 for r in sorted(index, key=lambda r: (r.shard, r.offset))]
    assert ids == sorted(ids)


def test_base_counts(spark, documents, awkward):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for table in (documents, awkward):
        rows = robust_outliers.base_statistics(table, "doc_id", "text").collect()
        assert len(rows) == table.count()
        for r in rows:
            assert {n: r[n] for n in names} == brute.base_counts(r.text)


def test_outliers_awkward(awkward, empty):
    rows = robust_outliers.verdicts(awkward).collect()
    assert len(rows) == awkward.count() and not any(r.kept for r in rows if r.base_failed)
    assert all(r.kept is not None for r in rows)
    assert robust_outliers.verdicts(empty).count() == 0
    assert robust_outliers.kept_documents(awkward).columns == awkward.columns


def test_outliers_follow_a_plain_estimate(spark):
    """One large group with a tenth of outliers: the estimate is that of the clean rows, the outliers go."""
    rng = np.random.default_rng(5)
    clean = rng.multivariate_normal([1.6, 0.1, 0.2, 0.3], np.diag([0.04, 0.01, 0.02, 0.02]) + 0.005, 4000)
    bad = rng.normal([4.0, 2.0, 2.0, 0.3], 0.05, (400, 4))
    rows = [(i, "en", "s", False, *map(float, x)) for i, x in enumerate([*clean, *bad])]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, source string, base_failed boolean, x0 double, x1 double, x2 double, x3 double")
    params = robust_outliers.estimates(frame)
    own = params.where("not _g.pooled").first()
    assert own.n == 4400
    assert np.allclose([own[f"m{i}"] for i in range(4)], clean.mean(axis=0), atol=0.03)
    found = np.array([[own[f"c{max(i, j)}{min(i, j)}"] for j in range(4)] for i in range(4)])
    assert np.allclose(found, np.cov(clean.T), atol=0.03)
    kept = {r.doc_id: r.kept for r in robust_outliers.judged(frame, params).collect()}
    assert not any(kept[i] for i in range(4000, 4400)) and sum(kept[i] for i in range(4000)) >= 3990


def test_rules(spark, documents, awkward, empty):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = rule_ensemble.classify(documents, labels, 3, 1).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents.select("doc_id").collect())
    for r in rows:
        assert r.held_out == (brute.remainder(r.doc_id, 3) == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    odd = rule_ensemble.classify(awkward, labels, 3, 1).collect()
    assert len(odd) == awkward.count() and all(0 <= r.score <= 1 for r in odd)
    assert rule_ensemble.classify(empty, labels, 3, 1).count() == 0
    assert rule_ensemble.classify(documents, labels.limit(0), 3, 1).select("score").distinct().count() == 1


def plain_statistics(text):
    text = text or ""
    w, counts = brute.words(text), brute.base_counts(text)
    n, chars = max(len(w), 1), max(len(text), 1)
    lines = [x for x in text.split("\n") if brute.words(x)]
    among = lambda marks: sum(c in marks for c in text) / chars
    return [
        math.log1p(len(w)),
        sum(map(len, w)) / n,
        math.log1p(max(map(len, w), default=0)),
        len(set(w)) / n,
        sum(a == b for a, b in zip(w, w[1:])) / n,
        counts["n_repeat_words"] / n,
        counts["n_symbols"] / chars,
        len(lines) / n,
        counts["n_dup_lines"] / max(len(lines), 1),
        among("0123456789"),
        among("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        among(".,;:!?"),
    ]


def test_rule_statistics(documents, awkward):
    for table in (documents, awkward):
        rows, names = rule_ensemble.statistics(table, "text")
        assert len(names) == 12
        for r in rows.collect():
            assert [r[n] for n in names] == pytest.approx(plain_statistics(r.text))


def test_good_documents(spark, documents, awkward, empty):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    mixed = awkward.unionByName(documents, allowMissingColumns=True)
    good = rule_ensemble.good_documents(mixed, labels, 3, 1)
    scored = [r for r in rule_ensemble.classify(mixed, labels, 3, 1).collect() if r.predicted]
    assert good.columns == mixed.columns
    assert sorted(str(r.doc_id) for r in good.collect()) == sorted(str(r.doc_id) for r in scored)
    whole = {tuple(r) for r in mixed.collect()}
    assert all(tuple(r) in whole for r in good.collect())
    assert rule_ensemble.good_documents(empty, labels, 3, 1).count() == 0
    assert rule_ensemble.good_documents(awkward, labels.limit(0), 3, 1).count() == awkward.count()


def test_rules_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = rule_ensemble.classify(docs, labels, 3, 1).where("held_out").join(labels, "doc_id").toPandas()
    one, zero = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    order = (one[:, None] > zero[None]).mean() + (one[:, None] == zero[None]).mean() / 2
    assert order > 0.95 and (held.predicted == held.quality).mean() > 0.95


def test_rules_compile_to_what_the_fit_scored(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(500, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 1] < 0.5) | (x[:, 2] > 0.9)).astype(float)
    model = rule_ensemble.fit(x, y, ["a", "b", "c"])
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double")
    scores = [r.s for r in frame.select("i", model.score().alias("s")).orderBy("i").collect()]
    assert np.allclose(scores, model.score_rows(x)) and ((np.array(scores) > 0.5) == y).mean() > 0.97


def test_chat_query(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").collect()
    turns = {}
    for r in sorted(rows, key=lambda r: r.turn):
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    turns[-1] = [("user", queries.MARKS), ("assistant", queries.MARKS)]
    got = {r.conv_id: r for r in queries.op6_chat_format(spark, SMALL).collect()}
    assert got.keys() == turns.keys()
    for conv, said in turns.items():
        out, loss = got[conv], "".join(t for role, t in said if role == "assistant")
        assert out.n_turns == len(said)
        assert out.turns_sha256 == brute.sha("".join(f"{role}\n{t}\n" for role, t in said))
        assert (out.loss_chars, out.loss_sha256) == (len(loss), brute.sha(loss))


def test_chat_merging_and_awkward(spark):
    nasty = "<|im_sep|>\\<|<\\|im_end|>\n\\\\|"
    said = [(i, r, t) for i, (r, t) in enumerate([("user", nasty), ("user", ""), ("user", "b"), ("assistant", nasty), ("ro\nle\\<|", "x")])]
    long = [(i, "assistant" if i % 700 > 250 else "user", f"t{i}") for i in range(2000)]
    rows = [(1, *t, "extra") for t in said] + [(2, *t, None) for t in long]
    rows += [(3, None, None, None, None), (3, 1, "user", "a", None), (3, 1, "user", "a", None), (None, 0, "assistant", "n", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    done = chat_format.format_conversations(frame)
    out = {
        r.conv_id: r
        for r in done.select(
            "conv_id", "n_merged", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"),
            chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        ).collect()
    }
    assert [tuple(t) for t in out[1].turns] == [t[1:] for t in said] and out[1].n_merged == 3 and out[1].loss == [nasty]
    assert [tuple(t) for t in out[2].turns] == [t[1:] for t in long]
    assert out[2].n_merged == 6 and out[2].loss == [t for _, r, t in long if r == "assistant"]
    assert [tuple(t) for t in out[3].turns] == [("", ""), ("user", "a"), ("user", "a")] and out[3].n_merged == 2
    assert out[None].loss == ["n"]
    assert done.limit(0).count() == 0 and chat_format.format_conversations(frame.limit(0)).count() == 0
