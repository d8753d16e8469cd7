"""Ranked search, packing and collocations against plain versions, and on odd input."""

import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpora import corpus, docs, empty, odd  # noqa: F401  (fixtures)
from logquarry.llm import collocations as phrases
from logquarry.llm import lexical, packing
from logquarry.llm.queries import QUERIES
from test_operators import python_nodes  # noqa: F401

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(rows, items, best=10):
    """Every document scored for every item."""
    found = [(key, Counter(TERM.findall((text or "").translate(LOWER)))) for key, text in rows]
    sizes = [sum(counts.values()) for _, counts in found]
    docs, total = sum(size > 0 for size in sizes), sum(sizes)
    df = Counter(term for _, counts in found for term in counts)
    out = []
    for item, text in items:
        wanted = Counter(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for (key, counts), n in zip(found, sizes):
            score = 0
            for term, times in wanted.items():
                if counts[term]:
                    m = 100 - 75 + (75 * n * docs) // total
                    w = math.floor(1000 * math.log((2 * docs + 2) / (2 * df[term] + 1)))
                    score += times * w * ((1_000_000_000 * counts[term]) // (1000 * counts[term] + 8 * m))
            if score > 0:
                scores.append((-score, key is None, key))
        scores.sort(key=lambda row: (row[0], row[1], row[2] or 0))
        out += [(item, rank, key, -score) for rank, (score, _, key) in enumerate(scores[:best], 1)]
    return out


ITEMS = [
    (0, "w1 W2 w3 w3 w300"), (1, "buy NOW!! w7"), (2, None), (3, ""), (4, "nothinglikeit"), (5, "漢字 é one"),
    (6, "this line stands in many documents w10 w11"), (7, "w5"), (8, " ".join(f"w{at}" for at in range(400))), (9, "w5"),
]


def searched(df, items, **how):
    return sorted((tuple(row) for row in lexical.lexical_search(df, items, **how).collect()), key=lambda row: row[:2])


def test_search_equals_scoring_everything(spark, docs, corpus, odd, empty, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(row[0], row[1]) for row in corpus]
    expected = plain_search(rows, ITEMS)
    assert searched(docs, items) == expected and len({row[0] for row in expected}) == 7
    # Many small segments in few tasks, items in blocks, and another number of best documents.
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 3)
    monkeypatch.setattr(lexical, "SEGMENT_CELLS", 2_000)
    assert searched(docs.coalesce(1), items, best=3) == plain_search(rows, ITEMS, 3)
    # Null ids rank behind equal scores, repeated rows and ids are documents of their own, clashing columns stay out.
    rows = [(row["doc_id"], row["text"]) for row in odd.collect()]
    assert searched(odd, items.withColumn("doc_id", F.lit(1))) == plain_search(rows, ITEMS)
    assert lexical.lexical_search(odd, items).columns == ["item_id", "rank", "doc_id", "score"]
    assert searched(empty, items) == [] and searched(docs, items.limit(0)) == []


def test_search_stops_before_the_end():
    """Best positions end a search that the depth read would not, and ties at the last place are all met."""
    rng = np.random.default_rng(3)
    for trial in range(40):
        number = {b"t%d" % at: at for at in range(4)}
        segment = lexical.Segment(number)
        for doc in range(600):
            words = [b"t%d" % at for at in range(4) for _ in range(int(rng.integers(0, 4)) * (rng.random() < 0.5))]
            segment.add(doc, b" ".join([*words, *[b"other"] * int(rng.integers(1, 4))]))
        row = segment.row()
        lists = lexical.ImpactLists(row, 600, row["terms"])
        weight = rng.integers(1, 900, 4)
        whole = weight @ lists.impact[lists.position]
        best = sorted(zip((-whole).tolist(), range(600)))[:10]
        found, scores = lists.search(np.arange(4), weight, 10, 0)
        assert sorted(zip((-scores).tolist(), found.tolist()))[:10] == best
        assert set(np.flatnonzero(whole >= -best[-1][0])) == set(found.tolist())
        # A higher floor returns only what reaches it.
        found, scores = lists.search(np.arange(4), weight, 10, -best[2][0])
        assert set(found.tolist()) == set(np.flatnonzero(whole >= -best[2][0]))
    skewed = lexical.Segment({b"a": 0, b"b": 1})
    for doc in range(4000):
        skewed.add(doc, b"a b" if doc < 12 else b"a x x x x x x x x" if doc % 2 else b"b y y y y y y y y")
    lists = lexical.ImpactLists(row := skewed.row(), 4000, row["terms"])
    lists.search(np.arange(2), np.array([5, 5]), 10, 0)
    assert int((lists.met == lists.searches).sum()) < 100


def test_both_ways_of_encoding_agree(corpus, tmp_path):
    texts = [row[1] or "" for row in corpus] + ["a<|endoftext|> b<|endoftext|>", " " * 5000 + "\n\n  x", "".join(map(chr, range(0x20, 0x3000)))]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    fast = packing._encoder(TOKENIZER)
    assert all(list(fast(text)) == tokenizer.encode(text, add_special_tokens=False).ids for text in texts)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        other = json.loads(Path(public_tokenizers.path(name)).read_text())
        if name.startswith("byte"):
            other["model"]["merges"][5], other["model"]["merges"][6] = other["model"]["merges"][6], other["model"]["merges"][5]
        assert packing._as_ranks(other) is None
        path = tmp_path / name
        path.write_text(json.dumps(other))
        tokenizer = Tokenizer.from_file(str(path))
        assert all(list(packing._encoder(str(path))(text)) == tokenizer.encode(text, add_special_tokens=False).ids for text in texts)


def plain_pieces(rows, size):
    tokenizer, out = Tokenizer.from_file(TOKENIZER), []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= size else len(ids) % size or size
        at = piece = 0
        while at < len(ids):
            end = first if not at else at + size
            out.append((key, piece, at, end - at, zlib.crc32(np.array(ids[at:end], dtype="<u4").tobytes())))
            at, piece = end, piece + 1
    return out


def check_packed(packed, rows, size):
    assert Counter(row[:5] for row in packed) == Counter(plain_pieces(rows, size))
    sequences = defaultdict(list)
    for row in packed:
        sequences[row[5]].append((row[6], row[3]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


@pytest.mark.parametrize("size", [1024, 50])
def test_packing_places_every_piece(docs, corpus, odd, empty, size):
    rows = [(row[0], row[1]) for row in corpus]
    packed = [tuple(row) for row in packing.pack_documents(docs, TOKENIZER, size=size).collect()]
    used = check_packed(packed, rows, size)
    total = sum(row[3] for row in packed)
    assert -(-total // size) <= used <= 1.03 * total / size + 1
    rows = [(row["doc_id"], row["text"]) for row in odd.collect()]
    check_packed([tuple(row) for row in packing.pack_documents(odd, TOKENIZER, size=size).collect()], rows, size)
    special = odd.limit(1).withColumn("text", F.lit("a<|endoftext|>b"))
    assert packing.pack_documents(special, TOKENIZER).first()["length"] == 4
    result = packing.pack_documents(empty, TOKENIZER)
    assert result.count() == 0 and result.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_fullest_equals_trying_all_combinations():
    rng = random.Random(5)
    for _ in range(200):
        lengths = [rng.randrange(1, 30) for _ in range(rng.randrange(0, 9))]
        room = rng.randrange(0, 70)
        best = max(sum(some) for n in range(len(lengths) + 1) for some in combinations(lengths, n) if sum(some) <= room)
        counts = Counter(lengths)
        taken = packing.fullest(counts, room)
        assert sum(length * number for length, number in taken) == best
        assert all(number <= counts[length] for length, number in taken)


def test_pack_lengths_uses_every_piece_once():
    rng = random.Random(6)
    for most in (9, 1024):
        counts = {length: rng.randrange(0, 10**6) for length in range(1, most + 1)}
        patterns = packing.pack_lengths(counts, 1024)
        used = Counter()
        for times, parts in patterns:
            assert sum(length * number for length, number in parts) <= 1024
            for length, number in parts:
                used[length] += times * number
        assert used == Counter({length: count for length, count in counts.items() if count})
        assert sum(times for times, _ in patterns) <= 1.01 * sum(a * b for a, b in counts.items()) / 1024 + 1
        assert len(patterns) <= 12 * most


def plain_phrases(rows, max_words, least, percent, best):
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, max_words + 1):
                counts[lang].update(tuple(words[at : at + k]) for at in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {phrase: a for phrase, a in f.items() if len(phrase) > 1 and a >= least}
        dropped = set()
        for longer, b in candidates.items():
            for k in range(2, len(longer)):
                for at in range(len(longer) - k + 1):
                    part = longer[at : at + k]
                    if 100 * b >= percent * f[part]:
                        dropped.add(part)
        rows = []
        for phrase, a in candidates.items():
            if phrase not in dropped:
                cuts = [(10**6 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("max_words", "shard_words"), [(3, 1 << 21), (3, 50), (4, 37), (2, 700)])
def test_collocations_equal_counting_everything(spark, odd, max_words, shard_words):
    rng = random.Random(11)
    texts = ["\t".join(rng.choices("AbcdefÄ", k=40)) + rng.choice(".,;:!?\n") + " x y  z" * 9 + "\r" for _ in range(60)]
    texts += ["same words again " * 60, None, "", " . , ", "a b c d " * 300]
    rows = [(rng.choice(["en", "de", None, "und"]), text) for text in texts]
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("rank", F.lit("clash")).repartition(2)
    for least, best in ((10, 2000), (3, 7)):
        found = phrases.collocations(df, max_words=max_words, least=least, best=best, shard_words=shard_words, bucket_words=shard_words)
        assert sorted(tuple(row) for row in found.collect()) == plain_phrases(rows, max_words, least, 50, best)


def test_collocations_of_odd_rows(odd, empty):
    rows = [(row["lang"], row["text"]) for row in odd.collect()]
    found = phrases.collocations(odd, least=2, best=None, shard_words=100)
    assert sorted(tuple(row) for row in found.collect()) == plain_phrases(rows, 3, 2, 50, None)
    result = phrases.collocations(empty)
    assert result.count() == 0 and result.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_scores_beyond_64_bits(spark):
    rows = [(9 * 10**14, 10**15, 10**15), (10**12, 10**12, 10**12), (10, 3 * 10**15, 7)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = [row[0] for row in df.select(phrases._exact_score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [10**6 * a * a // (left * right) for a, left, right in rows]


def test_index_counts_every_extension():
    rng = np.random.default_rng(2)
    text = np.concatenate([[0], rng.integers(0, 6, 500), [0]]).astype(np.int32)
    index, row = phrases.FMIndex(text), text.tolist()
    word = np.unique(text[text > 0])
    low, size = index.starts[word], index.starts[word + 1] - index.starts[word]
    owner, right, count, smaller = index.extend(index.after(1), low, size)
    pairs = Counter((a, b) for a, b in zip(row, row[1:]) if a and b)
    assert {(int(word[o]), int(r)): int(c) for o, r, c in zip(owner, right, count)} == pairs
    # The intervals of pairs, from single words by a step to the right, serve steps to the left.
    low, size = low[owner] + smaller, count
    suffixes = index.suffixes(2)
    assert all((row[suffixes[at]], row[suffixes[at] + 1]) == (word[o], r) for at, o, r in zip(low, owner, right))
    owner, left, count, _ = index.extend(index.before(2), low, size)
    triples = Counter(t for t in zip(row, row[1:], row[2:]) if all(t))
    got = {(int(left[i]), *(row[suffixes[low[o]] + k] for k in (0, 1))): int(count[i]) for i, o in enumerate(owner)}
    assert got == triples
    start, deeper = index.start(index.before(2), left, low[owner]), index.suffixes(3)
    assert all(row[deeper[at]] == one for at, one in zip(start, left))


def test_registered():
    assert {"op11_lexical_search", "op12_best_fit_packing", "op13_collocations"} <= set(QUERIES)
