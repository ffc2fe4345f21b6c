import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagelode.llm import packing
from pagelode.llm.common import stored
from tests.llm.tables import clashing, documents, prose, texts

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

ODD = [
    *texts(),
    "á b ́x ý",
    "x\x1cy a\xa0c d　e",
    "<|endoftext|> x<|endoftext|>y it's we'll",
    "Σς ΑΣ ᄀ ᅡ \x01 a \x01b\x01 c\x01",
    "0123456789 1.5e-7 __init__ !!!???",
    "é" * 3000,
    "Onbleon thesouer ERLYIN bleanat erlyea. Ist zz Q aB " + "supercalifragilistic" * 40,
]


def whole_ids(text):
    own = packing.encoder(TOKENIZER).tokenizer
    return [*own.encode(text or "", add_special_tokens=False).ids, 0]


def check(pieces, wanted, capacity):
    """Pieces rebuild the documents, and sequences are filled without gaps or overlaps."""
    docs = defaultdict(list)
    for row in pieces:
        docs[row["id"]].append(row)
    assert docs.keys() == wanted.keys()
    for doc, own in docs.items():
        for place, row in enumerate(sorted(own, key=lambda r: r["piece"])):
            ids = wanted[doc][place * capacity : (place + 1) * capacity]
            assert (row["piece"], row["start"], row["length"]) == (place, place * capacity, len(ids))
            assert row["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert sum(row["length"] for row in own) == len(wanted[doc])
    taken = defaultdict(list)
    for row in pieces:
        taken[row["sequence_id"]].append((row["offset"], row["length"]))
    for own in taken.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(taken)


@pytest.mark.parametrize("capacity", [2048, 100, 7])
def test_pieces_and_sequences(spark, capacity):
    docs = clashing(documents(spark, ODD)).repartition(5)
    pieces = stored(packing.token_pieces(docs, TOKENIZER, capacity=capacity, with_ids=True), "pieces")
    placed = stored(packing.pack(pieces, capacity), "placed")
    wanted = {i: whole_ids(text) for i, text in enumerate(ODD)}
    count = check(placed.collect(), wanted, capacity)
    total = sum(map(len, wanted.values()))
    assert count <= -(-total // capacity) * 1.02 + 1
    ids = {r["sequence_id"]: r["ids"] for r in packing.sequences(pieces, placed).collect()}
    assert len(ids) == count
    for row in placed.collect():
        own = wanted[row["id"]][row["start"] : row["start"] + row["length"]]
        assert ids[row["sequence_id"]][row["offset"] : row["offset"] + row["length"]] == own


def test_repeated_rows_bins_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 7)
    docs = documents(spark, ["same text"] * 90 + [prose(3, 40)] * 60, [5] * 50 + [None] * 50 + [6] * 50)
    placed = packing.pack(stored(packing.token_pieces(docs, TOKENIZER, capacity=64), "pieces"), 64)
    rows = placed.collect()
    assert Counter(row["id"] for row in rows if row["piece"] == 0) == {5: 50, None: 50, 6: 50}
    places = Counter((row["sequence_id"], row["offset"]) for row in rows)
    assert max(places.values()) == 1
    used = defaultdict(int)
    for row in rows:
        used[row["sequence_id"]] += row["length"]
    assert max(used.values()) <= 64
    none = packing.token_pieces(documents(spark, []), TOKENIZER)
    assert packing.pack(stored(none, "pieces")).collect() == []


def test_encoder_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_BYTES", 1000)
    monkeypatch.setattr(packing, "GROUP_CHARS", 50)
    monkeypatch.setattr(packing, "CALL_CHARS", 20)
    own = packing.Encoder(TOKENIZER)
    for text, ids in zip(ODD, own.encode(ODD), strict=True):
        assert [*ids.tolist(), 0] == whole_ids(text)


def filled(chosen, capacity):
    got = Counter()
    for configuration, times in chosen:
        assert sum(length * n for length, n in configuration) <= capacity and times > 0
        for length, n in configuration:
            got[length] += n * times
    return got


@pytest.mark.parametrize("seed", range(4))
def test_configurations_hold_every_piece(seed):
    pick = random.Random(seed)
    counts = {pick.randrange(1, 200): pick.randrange(1, 400) for _ in range(pick.randrange(1, 60))}
    chosen = packing.configurations(counts, 200)
    assert filled(chosen, 200) == counts
    least = -(-sum(length * n for length, n in counts.items()) // 200)
    plain = sum(times for _, times in packing.best_fit(counts, 200))
    count = sum(times for _, times in chosen)
    assert least <= count <= 1.001 * plain + 1


def test_knapsack_equals_brute_force():
    pick = random.Random(7)
    for _ in range(30):
        lengths = np.array(sorted(pick.sample(range(1, 15), 4)))
        prices = np.array([pick.random() for _ in lengths])
        best = [0.0] * 21
        for room in range(1, 21):
            best[room] = max([best[room - 1], *(best[room - n] + p for n, p in zip(lengths, prices, strict=True) if n <= room)])
        taken = packing.knapsack(prices, lengths, 20)
        worth = sum(prices[list(lengths).index(n)] * times for n, times in taken.items())
        assert sum(n * times for n, times in taken.items()) <= 20
        assert worth == pytest.approx(best[20])


def test_halves_thirds_and_whole_sequences():
    assert sum(t for _, t in packing.configurations({100: 5000, 50: 4000, 25: 0}, 100)) == 7000
    assert sum(t for _, t in packing.configurations({60: 3000, 40: 3000}, 100)) == 3000
    assert packing.configurations({}, 100) == []
