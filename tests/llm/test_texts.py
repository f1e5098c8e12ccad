"""Packing, mixing, exact and line dedup, token output."""

import math
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer

from docbatch.llm.exact_dedup import exact_dedup
from docbatch.llm.line_dedup import LineRuns, line_dedup
from docbatch.llm.mixing import mix, mixed_copies
from docbatch.llm.packing import best_fit, pack
from docbatch.llm.queries import op2_source_mixing
from docbatch.llm.textio import WordTokenizer
from docbatch.llm.token_output import decode_ranks, encode_ranks, read_tokens, write_tokens

from .brute import WORD, crc, rows, sha, targets, token_ids

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "a line that is long enough to count as one, number "


def odd_docs(n=60, seed=5):
    rnd = random.Random(seed)
    out = [(0, None, "en", None, 0), (1, "", None, "s", 0), (2, " \t\n ", "en", "s", 4), (3, "one", "en", "s", 3), (3, "one", "en", "s", 3), (4, "é " * 9000, "fr", "b", 18000), (5, "x" * 20000, "en", "b", 20000)]
    for i in range(6, n):
        lines = [LINE + str(rnd.randrange(6)) if rnd.random() < 0.6 else "short " + str(rnd.random()) for _ in range(rnd.randrange(1, 9))]
        out.append((i, rnd.choice(["\n", "\n ", "\n\n"]).join(lines) * rnd.choice([1, 1, 1, 40]), "en", rnd.choice(["s", "b", "c", None, "Ä"]), None))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_docs(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("path,spaced", [(WORDS, False), (BYTES, True)])
def test_word_tokenizer_equals_whole_text(path, spaced):
    rnd = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "é", "1", "23", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|", "word", " ", "　", "ab'll", "İ", "ß", "é", "\r\n", "日本", "\x1c"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(3000)] + [None, "", " ", "\n"]
    tok = Tokenizer.from_file(path)
    want = [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    own = WordTokenizer(path, spaced, max_words=500)
    for at in range(0, len(texts), 100):
        ids, offsets = own.encode(pa.array(texts[at : at + 100]))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == want[at : at + 100]


def test_best_fit_bins():
    sizes = np.array(random.Random(3).choices(range(1, 4097), k=3000))
    own, offset, fill = best_fit(sizes, 4096)
    for b in range(len(fill)):
        inside = sorted((o, s) for o, s in zip(offset[own == b], sizes[own == b], strict=True))
        assert [o for o, _ in inside] == np.cumsum([0, *[s for _, s in inside]])[:-1].tolist() and fill[b] == sum(s for _, s in inside) <= 4096
    assert len(fill) <= 1.02 * math.ceil(sizes.sum() / 4096) + 1


@pytest.mark.parametrize("parts", [1, 40])
def test_pack(spark, docs, parts):
    out = rows(pack(docs.repartition(parts), WORDS, end_id=1, capacity=256, keep_ids=True))
    want = defaultdict(list)
    for d, t, *_ in odd_docs():
        want[d].append(token_ids(WORDS, t, 1))
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    for d, all_ids in want.items():
        got = sorted((r["start"], r["piece"], r["length"], r["ids_crc32"]) for r in by[d])
        assert got == sorted((a, a // 256, len(ids[a : a + 256]), crc(ids[a : a + 256])) for ids in all_ids for a in range(0, len(ids), 256))
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0, *[n for _, n in b]])[:-1].tolist() and sum(n for _, n in b) <= 256
    short = sum(1 for b in bins.values() if 2 * sum(n for _, n in b) <= 256)
    assert short <= 1 and len(bins) <= 1.08 * sum(r["length"] for r in out) / 256 + 2
    assert pack(empty(spark), WORDS).count() == 0


def test_mixing(spark, docs):
    data = odd_docs() + [(100 + i, "w " * (1 + i % 37), "en", "hot" if i % 3 else "b", 0) for i in range(3000)]
    df = spark.createDataFrame(data, SCHEMA)
    out = rows(mixed_copies(df, rows_per_salt=100))
    size = defaultdict(int)
    for _, t, _, s, _ in data:
        size[s] += len(WORD.findall(t or ""))
    want, taken, longest = targets(size), defaultdict(int), defaultdict(int)
    assert len(out) == len(data)
    for r in out:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-9) and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in size:
        assert abs(taken[s] - want[s]) <= 2 * longest[s] + 1
    again = rows(mixed_copies(df.repartition(7), rows_per_salt=100))
    key = lambda r: (r["doc_id"], r["copies"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    mixed = rows(mix(df.withColumn("n", df["doc_id"]), (1, 2, 3)))
    assert len(mixed) == sum(r["copies"] for r in out) and set(mixed[0]) == {"doc_id", "text", "lang", "source", "n_chars", "n"}
    assert mixed_copies(empty(spark)).count() == 0 == mix(empty(spark)).count()


def test_mixing_query_near_targets(spark):
    taken, target = defaultdict(int), {}
    for r in rows(op2_source_mixing(spark, "/root/testdata/sf0.01")):
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert sum(abs(taken[s] - target[s]) for s in target) <= 0.05 * sum(target.values())


@pytest.mark.parametrize("block,batch", [(4096, 512), (3, 2)])
def test_exact_dedup(spark, docs, block, batch):
    data = [(d, t) for d, t, *_ in odd_docs()] + [(200, "one "), (201, " one "), (202, "one\n\t"), (None, " one\n"), (None, None)]
    out = rows(exact_dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(3), block, batch))
    groups = defaultdict(list)
    norm = lambda t: __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for d, t in data:
        groups[norm(t)].append(d)
    want = sorted((str(d), str(min((x for x in g if x is not None), default=None)), len(g), sha(t)) for t, g in groups.items() for d in g)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in out) == want
    assert sum(r["kept"] for r in out) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])
    assert exact_dedup(empty(spark)).count() == 0


def test_line_dedup(spark, docs):
    data = [r for r in odd_docs()] + [(None, LINE + "0\nother", "en", "s", 1)]
    df = spark.createDataFrame(data, SCHEMA).withColumn("n_lines", docs["doc_id"] if False else __import__("pyspark").sql.functions.lit("clash"))
    key = lambda x: __import__("re").sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    small = lambda d: -1 if d is None else d
    held = defaultdict(set)
    for d, t, *_ in data:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(small(d))
    want = []
    for d, t, *_ in data:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= 5 and max(held[key(x)]) != small(d))]
        want.append((str(d), len(lines), len(lines) - len(kept), "\n".join(kept)))
    for batches, fanout in ((4, 2), (1, 4)):
        out = rows(line_dedup(df, batches=batches, fanout=fanout))
        assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in out) == sorted(want)
    assert sum(n for _, _, n, _ in want) > 20
    assert line_dedup(empty(spark)).count() == 0


def test_line_runs_compact(spark):
    runs = LineRuns(fanout=2)
    for k in range(5):
        batch = spark.createDataFrame([(i, 0, k) for i in range(k * 3, k * 3 + 6)], "h1 long, h2 long, keeper long")
        runs.add(runs.unseen(batch))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert sorted((r["h1"], r["keeper"]) for r in rows(runs.all())) == [(i, max(0, i // 3 - 1)) for i in range(18)]


def test_rank_codes():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 1000):
        values = rnd.integers(0, 2 ** rnd.integers(1, 33, n), dtype=np.uint64).astype(np.uint32) if n else np.zeros(0, np.uint32)
        assert decode_ranks(*encode_ranks(values), n).tolist() == values.tolist()


def test_token_output(spark, docs):
    data = sorted([r[:2] for r in odd_docs()] + [(7000, None), (7001, "  two  spaces \n x")], key=lambda r: r[0])
    out = sorted(rows(read_tokens(spark, write_tokens(spark.createDataFrame(data, "doc_id long, text string").repartition(5), BYTES), keep_ids=True)), key=lambda r: r["start"])
    at = 0
    for (d, t), r in zip(data, out, strict=True):
        ids = token_ids(BYTES, t, 2)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, at, len(ids), crc(ids)) and np.frombuffer(r["ids"], "<u4").tolist() == ids
        at += len(ids)
    assert read_tokens(spark, write_tokens(empty(spark), BYTES)).count() == 0


@pytest.mark.parametrize("partition", [0, 1 << 20, (1 << 31) - 1])
def test_batch_numbers_of_late_partitions(monkeypatch, partition):
    """Tasks of huge tables: no number leaves 64 bits, and none of another task is met."""
    from docbatch.llm import exact_dedup as module

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return partition

    monkeypatch.setattr(module, "TaskContext", Context)
    table = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array([f"text {i}" for i in range(10)]), pa.array([b"d"] * 10)], names=["doc_id", "norm", "digest"])
    out = pa.Table.from_batches(list(module._cut(4096, 4)(iter([table]))))
    assert pc.unique(out.column("batch")).to_pylist() == [(partition << 32) + k for k in range(3)]
    assert [r for r in out.column("uid").to_pylist() if r is not None] == [0, 1, 2, 3, 0, 1, 2, 3, 0, 1]
