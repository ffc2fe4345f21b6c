import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pagelode.llm import lexical
from tests.llm.tables import WORDS, clashing, documents, rows, texts

ITEMS = [
    (1, "river stone house of the walk"),
    (2, "the the the of"),
    (3, "River7 STONE12 é漢字 light3 green21 unheard"),
    (4, None),
    (5, "!!! ..."),
    (6, "seven31 table2 paper39 over1 under5 walk8 the3 and17 and17"),
    (1, "paper"),
    (None, "one two words"),
]


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def wanted(docs, items, k):
    counts = [(i, Counter(terms(text))) for i, text in docs]
    counts = [(i, own) for i, own in counts if own]
    n, total = len(counts), sum(own.total() for _, own in counts)
    df = Counter(term for _, own in counts for term in own)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, own in asked.items():
        scores = []
        for i, there in counts:
            m = 100 - 25 + (25 * there.total() * n) // total
            score = 0
            for term, times in own.items():
                if tf := there[term]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1)))
                    score += times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def corpus(count=700, seed=4):
    """Documents in groups of a vocabulary of their own, with copies."""
    pick = random.Random(seed)
    out = texts()
    for i in range(count):
        own = WORDS[i % 5 * 2 : i % 5 * 2 + 6]
        out.append(" ".join(pick.choice(own) + pick.choice(["", str(pick.randrange(40))]) for _ in range(30)))
    return out + out[-40:]


def items_frame(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize(("shard", "block", "k"), [(4096, 128, 20), (100, 8, 3), (64, 2, 20), (4096, 16, 1000)])
def test_equal_brute_force(spark, monkeypatch, shard, block, k):
    monkeypatch.setattr(lexical, "SHARD_ROWS", shard)
    monkeypatch.setattr(lexical, "BLOCK_ROWS", block)
    texts_ = corpus()
    ids = [None if i % 97 == 5 else i * 7 % 1000 for i in range(len(texts_))]
    docs = clashing(documents(spark, texts_, ids)).repartition(3)
    asked = lexical.item_terms(clashing(items_frame(spark)))
    only = asked if shard != 64 else None
    found = lexical.search(lexical.build(docs, only=only), asked, k)
    assert rows(found) == wanted(list(zip(ids, texts_, strict=True)), ITEMS, k)


def test_items_in_many_blocks(spark, monkeypatch):
    texts_ = corpus(60)
    items = [(i, text) for i, text in enumerate(texts_)]
    asked = lexical.item_terms(items_frame(spark, items))
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", 20_000)
    found = lexical.search(lexical.build(documents(spark, texts_), only=asked), asked, 5)
    assert rows(found) == wanted(list(enumerate(texts_)), items, 5)


def test_empty_tables(spark):
    asked = lexical.item_terms(items_frame(spark))
    assert rows(lexical.search(lexical.build(documents(spark, []), only=asked), asked)) == []
    index = lexical.build(documents(spark), only=lexical.item_terms(items_frame(spark, [])))
    assert rows(lexical.search(index, lexical.item_terms(items_frame(spark, [])))) == []
    assert rows(lexical.search(lexical.build(documents(spark, [None, "", "..."])), asked)) == []


def made(texts_, **sizes):
    counts = [Counter(terms(text)) for text in texts_]
    total = sum(own.total() for own in counts)
    return lexical.Shard(
        range(len(counts)),
        [own.total() for own in counts],
        [list(own) for own in counts],
        [list(own.values()) for own in counts],
        len(counts),
        total,
    )


def test_summaries_bound_their_blocks_and_blocks_are_skipped(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ROWS", 16)
    pick = random.Random(1)
    topics = [[f"t{t}w{i}" for i in range(30)] for t in range(12)]
    texts_ = [" ".join(["all", *(pick.choice(topics[i % 12]) for _ in range(40))]) for i in range(1200)]
    shard = made(texts_)
    dense = np.zeros((len(texts_), len(shard.vocabulary)), dtype=np.int64)
    dense[np.repeat(np.arange(len(texts_)), np.diff(shard.rows)), shard.cols] = shard.impacts
    for col in range(len(shard.vocabulary)):
        own = shard.docs[shard.lists[col] : shard.lists[col + 1]]
        assert sorted(own) == np.flatnonzero(dense[:, col]).tolist()
        for block in range(shard.first[col + 1] - shard.first[col]):
            members = own[block * 16 : (block + 1) * 16]
            at = slice(*shard.at[shard.first[col] + block : shard.first[col] + block + 2])
            top = np.zeros(len(shard.vocabulary), dtype=np.int64)
            top[shard.terms_of[at]] = shard.tops[at].astype(np.int64) * shard.step
            assert (dense[members].max(axis=0) <= top).all()
            assert ((dense[members].max(axis=0) > 0) == (top > 0)).all()
    best = lexical.Best(5)
    asked = [(f"t3w{i}", 1000) for i in range(6)] + [("all", 40)]
    scored = shard.search(asked, best)
    weights = np.zeros(len(shard.vocabulary), dtype=np.int64)
    for term, weight in asked:
        weights[shard.number[term]] = weight
    every = dense @ weights
    assert best.scores.tolist() == sorted(every.tolist(), reverse=True)[:5]
    assert scored < (every > 0).sum() / 2
