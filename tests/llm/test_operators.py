"""Operators on whole tables against plain versions, and on odd input."""

import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

import reference
from corpora import corpus, docs, empty, odd  # noqa: F401  (fixtures)
from logquarry.llm import bpe, components, mixing, quality, sharding
from logquarry.llm.fingerprints import document_fingerprints, edited_fingerprints
from logquarry.llm.jaccard_join import jaccard_join, one_per_class
from logquarry.llm.line_dedup import line_dedup
from logquarry.llm.suffix_dedup import suffix_dedup
from logquarry.llm.token_counts import token_counts
from logquarry.llm.toxicity import toxicity_scores

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def pairs(rows):
    return [(row[0], row[1]) for row in rows]


def by_id(df, *columns):
    return {row["doc_id"]: tuple(row[c] for c in columns) if len(columns) > 1 else row[columns[0]] for row in df.collect()}


def python_nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [word for word in ("Python", "Pandas", "Arrow") if word in plan]


def test_line_dedup(docs, corpus, odd, empty):
    found = line_dedup(docs)
    expected = reference.line_dedup(pairs(corpus))
    got = by_id(found.withColumn("text", F.coalesce("text", F.lit(""))), "n_lines", "n_dropped", "text")
    assert got == expected and sum(n for _, n, _ in expected.values()) > 5
    assert not python_nodes(found)
    result = line_dedup(odd)
    assert result.count() == odd.count() and result.columns == [*(c for c in odd.columns if c != "n_lines"), "n_lines", "n_dropped"]
    assert line_dedup(empty).count() == 0


def test_quality_counts_and_verdicts(docs, corpus, odd, empty):
    found = quality.quality_rules(docs, with_text=False)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = by_id(found, *names)
    assert got == {key: reference.quality_counts(text) for key, text in pairs(corpus)}
    assert not python_nodes(found)
    kept = by_id(found, "kept")
    assert all(kept[at] for at in range(40))
    shouting, symbols = len(corpus) - 4, len(corpus) - 3
    assert not kept[shouting] and not kept[symbols]
    assert sorted(r["doc_id"] for r in quality.quality_rules(docs, only_kept=True).collect()) == sorted(k for k, v in kept.items() if v)
    assert quality.quality_rules(odd).count() == odd.count()
    assert quality.quality_rules(empty).count() == 0


def test_label_model_finds_rates():
    """Votes drawn from known rates give these rates back."""
    rng, counts = random.Random(1), Counter()
    for _ in range(20_000):
        good = rng.random() < 0.8
        counts[tuple(1 if rng.random() < (0.998 if good else 0.5) else -1 for _ in quality.RULES)] += 1
    model = quality.fit_label_model(list(counts.items()))
    assert model.prior == pytest.approx(0.8, abs=0.03)
    assert all(rate == pytest.approx(0.5, abs=0.06) for rate in model.good_given_bad)
    assert quality.fit_label_model([]).prior == 0.5


def test_jaccard_join(docs, corpus, odd, empty):
    got = by_id(jaccard_join(docs), "class_id", "n_links")
    assert got == reference.jaccard_classes(pairs(corpus))
    assert got[3] == (2, 1) and got[5][0] == 4
    kept = sorted(r["doc_id"] for r in one_per_class(docs).collect())
    assert kept == sorted({cls for cls, _ in got.values()})
    assert jaccard_join(odd).count() == odd.count()
    assert one_per_class(odd).columns == odd.columns
    assert jaccard_join(empty).count() == 0 and one_per_class(empty).count() == 0


def test_jaccard_join_of_many_near_copies(spark):
    """A group beyond the small buckets and one block, where not all pairs are alike, and copies of its members."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    rows = []
    for key in range(330):
        words = list(base)
        for at in rng.sample(range(120), rng.randrange(4)):
            words[at] = f"n{key}"
        rows.append((key, " ".join(words)))
    rows += [(330 + at, rows[at][1]) for at in range(20)]
    got = by_id(jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")), "class_id", "n_links")
    assert got == reference.jaccard_classes(rows)


def test_components(spark):
    edges = [(at, at + 1) for at in range(0, 60) if at % 20 != 19] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {at: at // 20 * 20 for at in range(60)} | {100: 100, 101: 100}


def test_fingerprints(docs, corpus, odd, empty):
    found = edited_fingerprints(docs)
    rows = {r["doc_id"]: r for r in found.collect()}
    assert {key: r["edited_text"] for key, r in rows.items()} == reference.edited(pairs(corpus))
    assert all(r["n_chars"] == len(corpus[key][1] or "") for key, r in rows.items())
    own = by_id(document_fingerprints(docs), "fingerprint")
    assert all(own[key] == r["fingerprint"] for key, r in rows.items())
    assert own[2] == own[3] != own[1] and own[40] == own[41]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows.values())
    assert sum(rows[k]["near_edited"] for k in range(20, 40)) > sum(rows[k]["near_next"] for k in range(20, 40))
    assert not python_nodes(found)
    assert edited_fingerprints(odd).count() == odd.count()
    assert edited_fingerprints(empty).count() == 0
    assert edited_fingerprints(docs.where("doc_id = 7")).head()["near_next"] == 1.0


def test_bpe_round_trip(docs, corpus, odd, empty):
    ranks = bpe.read_ranks(open(RANKS, "rb"))
    ours = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = bpe.bpe_encode(docs.select("doc_id", "text"), RANKS, public_tokenizers.PATTERN)
    assert by_id(ids, "ids") == {key: ours.encode_ordinary(text or "") for key, text in pairs(corpus)}
    assert by_id(bpe.bpe_decode(ids, RANKS), "text") == {key: text or "" for key, text in pairs(corpus)}
    both = bpe.bpe_encode(odd.withColumn("back", F.lit(1)), RANKS, public_tokenizers.PATTERN, decoded_col="back")
    assert both.columns == [*(name for name in odd.columns if name != "text"), "ids", "back"]
    texts = [row["text"] or "" for row in odd.collect()]
    assert sorted((row["ids"], row["back"]) for row in both.collect()) == sorted((ours.encode_ordinary(text), text) for text in texts)
    assert bpe.bpe_encode(odd, RANKS, public_tokenizers.PATTERN).count() == odd.count()
    assert bpe.bpe_encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_on_random_texts(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 300)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 300)
    ranks = bpe.read_ranks(open(RANKS, "rb"))
    ours = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, rng = bpe.Encoder(ranks, public_tokenizers.PATTERN), random.Random(5)
    parts = ["a", "ing", "the", " ", "  ", "\n", "\t", "'s", "'ll", "12", "é", "漢字", "　", "\xa0", "!", "😀", "\x1c", "\x85", "\r\n"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(3000)]
    for text in texts:
        assert encoder.encode(text) == ours.encode_ordinary(text), text
    # Many at once, with pieces so long that few are left for most of their bytes, and batches without any text or word.
    texts += ["a" * 4000, "é" * 900 + " b", "=" * 700, "the " * 2000, " ".join(rng.choices(parts, k=4000))]
    for size in (1, 7, 400, len(texts)):
        for at in range(0, len(texts), size * (1 + 40 // size)):
            some = texts[at : at + size]
            assert encoder.encode_batch(pa.array(some)).to_pylist() == [ours.encode_ordinary(text) for text in some]
    for some in ([], [""], ["", " ", "  "]):
        assert encoder.encode_batch(pa.array(some, pa.string())).to_pylist() == [ours.encode_ordinary(text) for text in some]
    # Another pattern may match across blanks.
    words = tiktoken.Encoding("words", pat_str=r"\w+ \w+|[\s\S]", mergeable_ranks=ranks, special_tokens={})
    other = bpe.Encoder(ranks, r"\w+ \w+|[\s\S]")
    some = ["the thing is that", "a b c", "", "x  y"]
    assert other.encode_batch(pa.array(some)).to_pylist() == [words.encode_ordinary(text) for text in some] == [other.encode(text) for text in some]


@pytest.mark.parametrize("most", [0, 2_000, 24 << 20])
def test_bpe_words_of_earlier_batches(monkeypatch, most):
    monkeypatch.setattr(bpe, "MAX_WORD_BYTES", most)
    ranks = bpe.read_ranks(open(RANKS, "rb"))
    ours = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, rng = bpe.Encoder(ranks, public_tokenizers.PATTERN), random.Random(8)
    words = ["the", "the,", "", "x" * 70, "é" * 40, "a\nb", "漢字", "12's", *("".join(rng.choices("aeinst", k=rng.randrange(2, 9))) for _ in range(400))]
    for _ in range(30):
        some = [" ".join(rng.choices(words, k=rng.randrange(40))) for _ in range(20)]
        for again in (some, some[::-1]):
            assert encoder.encode_batch(pa.array(again)).to_pylist() == [ours.encode_ordinary(text) for text in again]
            assert encoder.words.nbytes + encoder.word_ids.nbytes + encoder.word_sizes.nbytes <= most
            assert max(map(len, encoder.words.to_pylist()), default=0) <= bpe.LONGEST_WORD


def test_bpe_runs_no_known_word_again(monkeypatch):
    encoder = bpe.Encoder(bpe.read_ranks(open(RANKS, "rb")), public_tokenizers.PATTERN)
    run, pieces = encoder.transducer.encode_all, []
    monkeypatch.setattr(encoder.transducer, "encode_all", lambda some: pieces.extend(some) or run(some))
    first = encoder.encode_batch(pa.array(["the thing, that is\nit", "the 漢字"])).to_pylist()
    assert pieces
    pieces.clear()
    assert encoder.encode_batch(pa.array(["the 漢字", "the thing, that is\nit"])).to_pylist() == first[::-1]
    assert not pieces
    encoder.encode_batch(pa.array(["the new thing,"]))
    assert pieces == [b" new"]


def test_bpe_decodes_cut_characters_and_refuses_unknown_ids(monkeypatch):
    monkeypatch.setattr(bpe, "DECODED_AT_ONCE", 5)
    tokens, rng = bpe._tokens(RANKS), random.Random(9)
    bytes_of = {rank: token for token, rank in bpe.read_ranks(open(RANKS, "rb")).items()}
    rows = [[rng.randrange(rng.choice((256, 50_000))) for _ in range(rng.randrange(40))] for _ in range(500)]
    ids = pa.array(rows, pa.list_(pa.int32()))
    texts = [b"".join(map(bytes_of.get, row)).decode("utf-8", "replace") for row in rows]
    assert bpe._texts_of(ids, tokens).to_pylist() == texts == ["".join(bpe.decode_stream(row, bytes_of)) for row in rows]
    assert bpe._texts_of(ids.slice(130, 7), tokens).to_pylist() == texts[130:137]
    for bad in (-1, len(bytes_of), None):
        with pytest.raises((IndexError, KeyError)):
            bpe._texts_of(pa.array([[1, bad]], pa.list_(pa.int32())), tokens)


def test_utf8_stream_at_every_cut():
    data = "aé漢😀z".encode() + b"\xff\xc3(\xe2\x82" + "é".encode()
    for cuts in itertools.combinations(range(len(data) + 1), 2):
        stream, a, b = bpe.Utf8Stream(), *cuts
        parts = [stream.feed(data[:a]), stream.feed(data[a:b]), stream.feed(data[b:]), stream.finish()]
        assert "".join(parts) == data.decode("utf-8", "replace")


def test_suffix_dedup(docs, corpus, odd, empty):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup(docs).collect()}
    expected = reference.suffix_dedup(pairs(corpus))
    assert got == expected and sum(n for _, n, _, _ in expected.values()) > 1000
    short = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup(docs, length=40, seed=12).collect()}
    assert short == {key: kept for key, (_, _, _, kept) in reference.suffix_dedup(pairs(corpus), 40).items()}
    assert suffix_dedup(odd).count() == odd.count()
    assert suffix_dedup(empty).count() == 0


def test_token_counts(docs, corpus, odd, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = by_id(token_counts(docs, MODEL, max_tokens=50), "n_bytes", "n_tokens", "over_limit")
    sizes = {key: len(model.encode(text or "")) for key, text in pairs(corpus)}
    assert got == {key: (len((text or "").encode()), sizes[key], sizes[key] > 50) for key, text in pairs(corpus)}
    assert token_counts(odd, MODEL).count() == odd.count()
    assert token_counts(empty, MODEL).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  ", "a ", " a", "  a  b ", "▁a ▁", "a\tb\nc", "<s> </s>", "　 x", "ab  \n c"])
def test_pre_tokens_lose_no_piece(text):
    from logquarry.llm import token_counts as tc

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert sum(tc.count_pieces(model, tc.pre_tokens(text))) == len(model.encode(text))


def test_sharding(spark, docs, corpus, odd, empty):
    rows = sharding.shard_documents(docs, n_shards=4).collect()
    texts, shards = dict(pairs(corpus)), defaultdict(list)
    for row in rows:
        data = (texts[row["doc_id"]] or "").encode()
        assert (row["size"], row["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
        shards[row["shard"]].append(row["slot"])
    assert len(rows) == len(corpus)
    assert all(sorted(slots) == list(range(len(slots))) for slots in shards.values())
    rng = random.Random(2)
    many = [(at, "w " * rng.randrange(1, 300)) for at in range(3000)] + [(3000 + at, "copy " * 50) for at in range(1500)]
    placed = sharding.shard_documents(spark.createDataFrame(many, "doc_id long, text string"), n_shards=8)
    sizes = [r[0] for r in placed.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 8 and max(sizes) < 1.01 * min(sizes)
    assert sharding.shard_documents(odd, n_shards=3).count() == odd.count()
    assert sharding.shard_documents(empty).count() == 0


def test_written_shards(spark, docs, corpus, tmp_path):
    clashing = docs.withColumns({name: F.lit(1) for name in ("_id", "_slot", "_shard", "_placed_id", "shard", "a.b")})
    sharding.write_shards(clashing, sharding.shard_documents(docs, n_shards=3), str(tmp_path / "clashing"))
    assert spark.read.parquet(str(tmp_path / "clashing")).count() == docs.count()
    sharding.write_shards(docs, sharding.shard_documents(docs, n_shards=3), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(r["doc_id"] for r in back.collect()) == [row[0] for row in corpus]
    assert {r["shard"] for r in back.select("shard").collect()} == {0, 1, 2}


def test_toxicity_on_held_out_rows(spark, odd, empty):
    rng = random.Random(4)
    bad = ["grumble", "snarl", "zounds", "fie"]
    rows, labels = [], []
    for key in range(900):
        toxic = key % 6 == 0
        words = [f"w{rng.randrange(500)}" for _ in range(60)]
        if toxic:
            words[10], words[30] = rng.choice(bad), rng.choice(bad)
        rows.append((key, " ".join(words)))
        labels.append((key, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None), (901, "")], "doc_id long, text string")
    table = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity_scores(docs, table).collect()}
    truth = dict(labels)
    assert len(found) == 902 and all(0 <= r["score"] <= 1 for r in found.values())
    held = [key for key in truth if zlib.crc32(str(key).encode()) % 5 == 0]
    assert all(found[key]["held_out"] == (zlib.crc32(str(key).encode()) % 5 == 0) for key in truth)
    assert np.mean([found[key]["predicted"] == truth[key] for key in held]) > 0.97
    flipped = spark.createDataFrame([(k, 1 - v if k in set(held) else v) for k, v in labels], "doc_id long, toxic int")
    assert {r["doc_id"]: r["score"] for r in toxicity_scores(docs, flipped).collect()} == {k: r["score"] for k, r in found.items()}
    assert toxicity_scores(odd, table.limit(0)).count() == odd.count()
    assert toxicity_scores(empty, table).count() == 0


def test_source_mix(docs, corpus, odd, empty):
    rows = mixing.mix_sources(docs, with_text=False).collect()
    words = {key: len(reference.WORD.findall(text or "")) for key, text in pairs(corpus)}
    source, taken = {row[0]: row[3] for row in corpus}, Counter()
    total = Counter()
    for row in rows:
        assert row["size"] == words[row["doc_id"]] and row["taken"] in (0, row["size"], 2 * row["size"])
        taken[source[row["doc_id"]]] += row["taken"]
        total[source[row["doc_id"]]] += row["size"]
    targets = {source[row["doc_id"]]: row["target"] for row in rows}
    assert sum(targets.values()) == pytest.approx(1.5 * sum(words.values()))
    assert all(targets[name] <= 2 * total[name] + 1e-6 for name in total)
    for name in total:
        # The sums that can be reached beside all documents once, where the target allows that.
        once = total[name] if targets[name] >= total[name] else 0
        reach = 1
        for key in words:
            if source[key] == name:
                reach |= reach << words[key]
        nearest = min(abs(once + at - targets[name]) for at in range(reach.bit_length()) if reach >> at & 1)
        assert abs(taken[name] - targets[name]) <= nearest + 1
    assert sorted(rows) == sorted(mixing.mix_sources(docs.repartition(5), with_text=False).collect())
    assert mixing.mix_sources(odd).count() == odd.count()
    assert mixing.mix_sources(empty).count() == 0


def test_fit_budget_is_exact():
    """Against all subsets."""
    rng = random.Random(6)
    for _ in range(200):
        lengths = np.array(sorted(rng.sample(range(0, 30), 4)))
        counts = np.array([rng.randrange(1, 4) for _ in lengths])
        budget = rng.randrange(0, int((lengths * counts).sum()) + 5)
        taken = mixing.fit_budget(lengths, counts, budget, 1)
        assert (0 <= taken).all() and (taken <= counts).all()
        reach = {int((lengths * np.array(x)).sum()) for x in itertools.product(*(range(c + 1) for c in counts))}
        assert abs(int((lengths * taken).sum()) - budget) == min(abs(r - budget) for r in reach)


def test_fit_budget_of_any_size():
    """One rule: exact up to twice the longest document, within half of it above."""
    assert int((mixing.fit_budget(lengths := np.array([100_000, 150_000, 170_000]), np.ones(3, dtype=int), 250_000, 1) * lengths).sum()) == 250_000
    rng = np.random.default_rng(1)
    for _ in range(150):
        lengths = np.unique(rng.integers(1, 300_000, 6))
        counts = rng.integers(0, 3, len(lengths))
        budget = int(rng.integers(0, max(int((lengths * counts).sum()), 1)))
        taken = mixing.fit_budget(lengths, counts, budget, 1)
        assert (0 <= taken).all() and (taken <= counts).all()
        missed = abs(int((lengths * taken).sum()) - budget)
        reach = {0}
        for length, count in zip(lengths.tolist(), counts.tolist()):
            reach = {total + some * length for total in reach for some in range(count + 1)}
        assert missed == min(abs(total - budget) for total in reach) if budget <= 2 * lengths.max() else missed <= lengths.max() / 2


def test_targets_stop_at_twice_the_size():
    assert mixing.source_targets([10, 100, 1000]) == pytest.approx([20, 200, 1445])
    assert mixing.source_targets([]) == [] and mixing.source_targets([0, 0]) == [0, 0]


def test_suffix_dedup_leaves_no_shuffle_of_its_first_round(spark, docs):
    def shuffles():
        return set(re.findall(r"shuffle_\d+", spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(" ")))

    before = shuffles()
    result = suffix_dedup(docs)
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.2)
    assert shuffles() <= before
    assert "Scan parquet" in result._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
