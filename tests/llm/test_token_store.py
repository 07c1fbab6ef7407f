import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import token_store
from lodestone.llm.queries import op10_token_store
from tests.oracle import SMALL

FILE = public_tokenizers.path("word_bpe_49k.json")


def expected(texts):
    """By doc_id: start, tokens and checksum, from the library's ids of whole texts."""
    whole, at, out = Tokenizer.from_file(FILE), 0, {}
    for doc, text in sorted(texts.items()):
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out[doc] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    return out


def test_query_equals_brute_force(spark):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op10_token_store(spark, SMALL).collect()}
    assert got == expected({r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()})


def test_many_shards_and_odd_rows(spark, odd, empty):
    known = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    manifest = token_store.write(known, FILE, "word", 1, shard_tokens=50)
    assert manifest.count() > 3
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.read(manifest).collect()}
    assert got == expected({r["doc_id"]: r["text"] for r in known.collect()})
    rows = sorted(token_store.read(token_store.write(odd, FILE, "word", 1)).collect(), key=lambda r: r["start"])
    assert len(rows) == odd.count() and [r["doc_id"] for r in rows[:2]] == [None, None]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
    assert token_store.read(token_store.write(empty, FILE, "word", 1)).count() == 0


@pytest.mark.parametrize("top", [1, 2, 3, 300, 70_000])
def test_matrix_equals_the_list(monkeypatch, top):
    monkeypatch.setattr(token_store, "CHUNK", 1024)
    rng = random.Random(top)
    ids = np.array([int(rng.random() ** 2 * top) for _ in range(2500)], np.uint32)
    shard = token_store.Shard(io.BytesIO(token_store.dump([7, None, 9], np.array([10, 1500, 2500]), ids)))
    assert shard.docs == [7, None, 9] and shard.ends.tolist() == [10, 1500, 2500]
    assert (shard.decode() == ids).all()
    for _ in range(100):
        i = rng.randrange(len(ids))
        token = int(ids[i])
        lo, hi = sorted((rng.randrange(2501), rng.randrange(2501)))
        places = np.flatnonzero(ids == token)
        j = rng.randrange(len(places))
        assert shard.access(i) == token
        assert shard.count(token, lo, hi) == int((ids[lo:hi] == token).sum())
        assert shard.locate(token, j) == places[j]
        assert shard.locate(token, len(places)) is None
        assert (shard.places(token) == places).all()
    assert shard.count(top + 5) == 0 and shard.locate(top + 5, 0) is None


def test_broken_files_are_refused():
    with pytest.raises(ValueError, match="not a wavelet"):
        token_store.Shard(io.BytesIO(b"something else entirely"))


def test_lookups_read_what_they_need(monkeypatch):
    """Counts of the whole shard read no planes; rank counts are in the file."""
    monkeypatch.setattr(token_store, "CHUNK", 8192)
    ids = np.random.default_rng(2).integers(0, 500, 400_000).astype(np.uint32)
    raw = token_store.dump([1], np.array([len(ids)]), ids)
    open_shard = lambda: token_store.Shard(io.BytesIO(raw))
    monkeypatch.setattr(token_store, "ranks", None)  # nothing is counted anew
    shard = open_shard()
    assert shard.access(54_321) == ids[54_321]
    assert shard.bytes_read < len(raw) / 4
    shard = open_shard()
    assert shard.count(77) == int((ids == 77).sum())
    assert shard.bytes_read < len(raw) / 20
    shard = open_shard()
    assert shard.count(77, 12_000, 13_000) == int((ids[12_000:13_000] == 77).sum())
    assert shard.bytes_read < len(raw) / 4
    shard = open_shard()
    assert shard.locate(77, 100) == np.flatnonzero(ids == 77)[100]
    assert shard.bytes_read < len(raw) / 4


def test_lookup_over_shards_equals_a_scan(spark, odd):
    known = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    manifest = token_store.write(known, FILE, "word", 1, shard_tokens=5000)
    whole, at, places = Tokenizer.from_file(FILE), 0, {}
    for r in sorted(known.collect(), key=lambda r: r["doc_id"]):
        ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for j, t in enumerate(ids):
            places.setdefault(t, []).append((r["doc_id"], at, j))
        at += len(ids)
    asked = [1, *sorted(places, key=lambda t: -len(places[t]))[:3], *sorted(places)[-3:], 48_999, 10**6]
    assert {r["token"]: r["n"] for r in token_store.count(manifest, asked).collect()} == {t: len(places.get(t, [])) for t in asked}
    for t in asked:
        assert sorted(map(tuple, token_store.locate(manifest, t).collect())) == places.get(t, [])
