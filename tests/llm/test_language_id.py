import numpy as np
import pytest

from lodestone.llm import language_id as ppm
from lodestone.llm.queries import op2_language_id

SF = "/root/testdata/sf0.01"


def grams(texts):
    found = {}
    for lang, text in texts:
        padded = b"\0" * ppm.ORDER + text.encode()
        for i in range(len(padded) - ppm.ORDER):
            key = lang, int.from_bytes(padded[i : i + ppm.ORDER + 1], "big")
            found[key] = found.get(key, 0) + 1
    return [k[0] for k in found], np.array([k[1] for k in found], np.int64), np.array(list(found.values()), np.int64)


def tree(training: list[bytes]) -> dict[bytes, dict[int, int]]:
    seen: dict[bytes, dict[int, int]] = {}
    for t in training:
        for i, b in enumerate(t):
            for depth in range(ppm.ORDER + 1):
                if i >= depth and 0 not in t[i - depth : i + 1]:
                    node = seen.setdefault(t[i - depth : i], {})
                    node[b] = node.get(b, 0) + 1
    return seen


def bits_of(seen: dict[bytes, dict[int, int]], text: bytes) -> float:
    """Method C, one byte after the other, from counts in dictionaries."""
    bits = 0.0
    for i, b in enumerate(text):
        for depth in range(min(ppm.ORDER, i), -1, -1):
            node = seen.get(text[i - depth : i])
            if not node:
                continue
            total, distinct = sum(node.values()), len(node)
            if b in node:
                bits -= np.log2(node[b] / (total + distinct))
                break
            bits -= np.log2(distinct / (total + distinct))
        else:
            bits += 8
    return bits


def code_length(training: list[bytes], text: bytes) -> float:
    return bits_of(tree(training), text)


TEXTS = [("a", "the cat sat on the mat, the hat"), ("a", "then he sat"), ("b", "der hund und die katze, üben"), ("b", "und dann das")]


@pytest.mark.parametrize("text", ["the cat", "hund und hut", "zzz 中", "x", "the\n", "üb"])
def test_code_lengths_equal_brute_force(text):
    model = ppm.compile_model(*grams(TEXTS))
    got = model.code_lengths(np.frombuffer(text.encode(), np.uint8))
    expected = [code_length([t.encode() for at, t in TEXTS if at == lang], text.encode()) for lang in model.languages]
    assert got == pytest.approx(expected, rel=1e-5)


def test_long_texts_are_scored_whole(monkeypatch):
    model = ppm.compile_model(*grams(TEXTS))
    text = np.frombuffer(("the cat sat und " * 50).encode(), np.uint8)
    whole = model.code_lengths(text)
    monkeypatch.setattr(ppm, "CHUNK", 7)
    assert model.code_lengths(text) == pytest.approx(whole)


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op2_language_id(spark, SF).filter("held_out").join(truth, "doc_id").collect()
    assert len(rows) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark, odd, empty):
    model = ppm.train(odd)
    assert model.languages == ["de", "en"]
    rows = ppm.identify(odd, model).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert all((by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0) for i in (1, 2, 3, 11))
    assert ppm.identify(empty, model).count() == 0


def test_nothing_learned(spark, odd, empty):
    model = ppm.train(empty)
    assert model.languages == []
    assert {r["lang_pred"] for r in ppm.identify(odd, model).collect()} == {"und"}


def test_labels_are_no_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    model = ppm.train(docs)
    swapped = docs.selectExpr("doc_id", "text", "'xx' AS lang", "'s' AS source")
    assert sorted(map(str, ppm.identify(docs, model).collect())) == sorted(map(str, ppm.identify(swapped, model).collect()))


def test_rare_languages_keep_their_contexts():
    """More contexts of a frequent language than 12,000 leave those of a rare one in the model."""
    rng = np.random.default_rng(0)
    frequent = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 80_000).tolist())
    texts = [("a", frequent), ("a", frequent), ("b", "ÄÖÜ ÖÄÜ ßÄÖ")]
    model = ppm.compile_model(*grams(texts))
    for text in ("ÄÖÜ ßÄÖ", frequent[100:160]):
        expected = [code_length([t.encode() for at, t in texts if at == lang], text.encode()) for lang in model.languages]
        assert model.code_lengths(np.frombuffer(text.encode(), np.uint8)) == pytest.approx(expected, rel=1e-5)


def test_query_equals_brute_force(spark):
    """Sample, counts, code lengths and posterior of the whole query, from the table alone."""
    import zlib

    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()
    apart = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in docs}
    langs = sorted({r["lang"] for r in docs if r["lang"] is not None and not apart[r["doc_id"]]})
    trees = [tree([r["text"].encode() for r in docs if r["lang"] == lang and r["text"] and not apart[r["doc_id"]]]) for lang in langs]
    got = {r["doc_id"]: r for r in op2_language_id(spark, small).collect()}
    assert len(got) == len(docs)
    for r in docs:
        row, text = got[r["doc_id"]], r["text"] or ""
        assert row["held_out"] == apart[r["doc_id"]]
        if not any(c.isalpha() for c in text):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        bits = np.array([bits_of(t, text.encode()) for t in trees])
        order = np.sort(bits)
        assert row["bits_per_byte"] == pytest.approx(order[0] / len(text.encode()), rel=1e-5)
        if order[1] - order[0] > 1e-2:
            assert row["lang_pred"] == langs[int(bits.argmin())]
            assert row["score"] == pytest.approx(1 / np.exp2(np.maximum(order[0] - bits, -1000)).sum(), abs=1e-2)


def test_size_is_linear_in_what_was_learned():
    """A script of its own costs the others nothing."""
    latin = [("a", "the cat sat on the mat, the hat " * 3), ("b", "der hund und die katze üben " * 3)]
    other = [("c", "кошка сидела на ковре " * 3)]
    size = lambda texts: ppm.compile_model(*grams(texts)).size
    assert size(latin + other) == size(latin) + size(other)
    many = [(f"l{i}", t) for i in range(20) for _, t in latin[:1]]
    assert size(many) == 20 * size(latin[:1])


def test_texts_of_a_batch_are_apart(monkeypatch):
    model = ppm.compile_model(*grams(TEXTS))
    texts = [np.frombuffer(t.encode(), np.uint8) for t in ("the cat", "x", "und dann \0 das", "ü" * 50)]
    alone = np.array([model.code_lengths(t) for t in texts])
    for chunk in (1, 5, 64, 1 << 20):
        monkeypatch.setattr(ppm, "CHUNK", chunk)
        assert model.code_lengths_of(texts) == pytest.approx(alone)
