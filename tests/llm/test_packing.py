import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import packing
from lodestone.llm.queries import op7_best_fit_packing
from lodestone.llm.tokens import Encoder
from tests.oracle import SMALL

FILES = {"byte": public_tokenizers.path("byte_bpe_50k.json"), "word": public_tokenizers.path("word_bpe_49k.json")}


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """Fill of each bin, item by item, by looking at every bin."""
    room: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(capacity - n)
    return sorted(capacity - r for r in room)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 64, 100])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.7 else rng.choice([1, 2, capacity // 2]) for _ in range(rng.randint(0, 400))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    steps = packing.plan(histogram, capacity)
    fill: dict[int, list] = {}
    for n, count in histogram.items():
        own = steps[steps[:, 0] == n]
        for rank in range(count):
            _, first_rank, first, each, offset = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
            nth = rank - first_rank
            fill.setdefault(first + nth // each, []).append((offset + nth % each * n, n))
    for placed in fill.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(sum(n for _, n in x) for x in fill.values()) == best_fit_decreasing(lengths, capacity)


def test_plan_size_depends_on_the_capacity():
    rng = random.Random(1)
    small = {n: rng.randint(1, 50) for n in range(1, 257)}
    large = {n: 10**9 * c + rng.randint(0, 10**6) for n, c in small.items()}
    assert len(packing.plan(large, 256)) < 6 * len(packing.plan(small, 256)) + 5000


def check(rows, texts, capacity=2048):
    whole = Tokenizer.from_file(FILES["byte"])
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc, text in texts.items():
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // capacity)))
        assert sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == capacity for r in own[1:])
        at = 0
        for r in own:
            assert r["start"] == at
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_query_equals_brute_force(spark):
    rows = op7_best_fit_packing(spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    bins = check(rows, texts)
    assert len(bins) == len(best_fit_decreasing([r["length"] for r in rows], 2048))


def test_odd_rows(spark, odd, empty):
    known = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = packing.pack(known, FILES["byte"]).collect()
    check(rows, {r["doc_id"]: r["text"] for r in known.collect()})
    assert packing.pack(odd, FILES["byte"]).select("doc_id").distinct().count() == known.count() + 1
    assert packing.pack(empty, FILES["byte"]).count() == 0


def test_ids_travel_on_request(spark, odd):
    rows = packing.pack(odd, FILES["byte"], capacity=100, with_ids=True).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_encoder_equals_the_library(spark, kind):
    encoder, whole = Encoder(FILES[kind], kind), Tokenizer.from_file(FILES[kind])
    rng = random.Random(5)
    alphabet = "ab'stre  \n\t.,!#12é\u0301\u00a0\u3000–—ΣσßİⅣ²~'’|_A\x1c\x85中文"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a  <|endoftext|> b  ~ \n\n x", "<|startoftext|>", "  ", "", "it's ~ don'T", "x" * 5000]
    texts += [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text[:80])


def test_encoder_forgets_and_stays_right():
    encoder, whole = Encoder(FILES["byte"], "byte", remembered=3), Tokenizer.from_file(FILES["byte"])
    for i in range(50):
        text = f"some words {i} and others {i % 7} again"
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) <= 3 + 20
