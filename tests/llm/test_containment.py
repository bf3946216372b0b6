"""Leaks against brute force over all runs of twelve words."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import containment
from weftline.llm.containment import leaked_items

DOCUMENTS = pa.schema([("id", pa.int64()), ("text", pa.string()), ("key", pa.string()), ("passage", pa.string())])
ITEMS = pa.schema([("item", pa.string()), ("text", pa.string()), ("__item", pa.int64()), ("minimum", pa.int64())])


def search(spark, documents, items, **how):
    d = spark.createDataFrame(pa.Table.from_pylist([{"id": k, "text": t} for k, t in documents], schema=DOCUMENTS)).repartition(3)
    i = spark.createDataFrame(pa.Table.from_pylist([{"item": k, "text": t} for k, t in items], schema=ITEMS))
    found = leaked_items(d, i, document_id="id", document_text="text", item_id="item", item_text="text", **how)
    assert found.columns == ["id", "item"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def brute(documents, items, n=12):
    def runs(t):
        words = [x.lower() for x in re.findall(r"[^\W_]+", t or "")]
        return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}

    known = [(k, runs(t)) for k, t in items]
    return sorted({(d, k) for d, t in documents for mine in [runs(t)] for k, other in known if mine & other}, key=str)


def dressed(rng, words):
    return "".join(rng.choice([x, x.upper(), x.title()]) + rng.choice([" ", "\n+ ", " — ", "_", "\xa0", ", "]) for x in words)


@pytest.mark.parametrize("block", [1 << 22, 40])
def test_against_brute_force(spark, block):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(30)] + ["straße", "İstanbul", "12", "語語", "½"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [some(rng.choice([3, 11, 12, 13, 40, 90])) for _ in range(25)]
    items = [(f"i{k}", " ".join(t)) for k, t in enumerate(texts)]
    items += [("i0", items[0][1]), (None, items[5][1]), ("none", None), ("empty", "")]
    documents = [(999, None), (998, ""), (None, " ".join(some(50)))]
    for k in range(150):
        body = some(rng.randrange(0, 400))
        for _ in range(rng.randrange(3)):
            t = rng.choice(texts)
            size = rng.choice([11, 12, 13, len(t)])
            at, cut = rng.randrange(len(body) + 1), rng.randrange(max(1, len(t) - size + 1))
            body[at:at] = t[cut : cut + size]
        documents.append((k, dressed(rng, body)))
    documents += documents[5:20]
    want = brute(documents, items)
    assert len(want) > 50
    assert search(spark, documents, items, block_minima=block) == want


def test_edges_of_texts_do_not_join(spark):
    words = [f"a{k}" for k in range(12)]
    documents = [(1, " ".join(words[:6])), (2, " ".join(words[6:])), (3, " ".join(words)), (4, "x" * 100_000 + " " + " ".join(words)), (5, "y " * 30_000 + "_".join(words))]
    assert search(spark, documents, [("i", " ".join(words))]) == [(3, "i"), (4, "i"), (5, "i")]


def test_pieces_overlap(monkeypatch):
    monkeypatch.setattr(containment, "PIECE_CHARACTERS", 200)
    words = [f"w{k}" for k in range(1000)]
    text = "  ".join(words)
    pieces = [p.split() for p in containment._pieces(text, 11)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["short", None, text])], names=["key", "text"])
    loads = list(containment._loads(batch, 11))
    assert [r for rows, _ in loads for r in rows] == [0, 1] + [2] * len(pieces) and len(loads) > 5
    assert len(pieces) > 10
    runs = {tuple(p[k : k + 12]) for p in pieces for k in range(len(p) - 11)}
    assert runs == {tuple(words[k : k + 12]) for k in range(989)}


def test_empty_tables_and_parameters(spark):
    assert search(spark, [], [("i", "a b c")]) == [] == search(spark, [(1, "a b c")], [])
    assert search(spark, [(1, "z a b c")], [("i", "A-B-C d")], passage_words=3, shingle_words=2) == [(1, "i")]
    assert search(spark, [(1, "z a b c")], [("i", "a b d c")], passage_words=3, shingle_words=3) == []
    with pytest.raises(ValueError):
        search(spark, [], [], passage_words=3)


def test_map_of_minima_knows_all_and_documents_are_read_once(spark):
    from weftline.llm.containment import _Listed, _Mapped

    rng = random.Random(5)
    minima = [rng.getrandbits(64) - 2**63 for _ in range(3000)]
    asked = np.array(minima + [rng.getrandbits(64) - 2**63 for _ in range(3000)], np.int64).view(np.uint64)
    df = spark.createDataFrame([(m,) for m in minima], "minimum long")
    for bits in (64, 1 << 16):
        assert _Mapped(df, bits).has(asked)[:3000].all()
    assert _Mapped(df, 1 << 16).has(asked)[3000:].mean() < 0.1
    assert _Listed(asked[:3000]).has(asked).tolist() == [True] * 3000 + [False] * 3000
    words = [f"w{k}" for k in range(200)]
    documents = [(k, " ".join(rng.choices(words, k=5) + words[k : k + 13] + rng.choices(words, k=5))) for k in range(40)]
    items = [(f"i{k}", " ".join(words[3 * k : 3 * k + 15])) for k in range(20)]
    assert search(spark, documents, items, block_minima=0, map_bits=128) == search(spark, documents, items)
