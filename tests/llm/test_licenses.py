from pagelode.llm.licenses import NOTICES, PHRASES, scan_licenses, template_words
from tests.llm import brute
from tests.llm.tables import clashing, documents, prose, rows, texts

MIT = NOTICES[1][1]
DOCS = [
    *texts(),
    "Released under the MIT License. cc by nc, CC-BY-NC cc by nc",
    "Apache License, Version 2.0 under the mit license under the MIT license",
    "apache license version 3; under the mit",
    f"{prose(1, 3000)} {MIT} {prose(2, 3000)}",
    " ".join(w + (" really" if i % 17 == 9 else "") for i, w in enumerate(MIT.split())),
    " ".join(MIT.split()[:12]),
    "This work is licensed under the GNU General Public License, version 3.",
]


def places(text):
    words = brute.plain_words(text)
    return sorted(
        (i, label)
        for label, phrase in PHRASES
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    )


def test_base_places_equal_brute_force(spark):
    found = {r["id"]: r for r in scan_licenses(documents(spark, DOCS)).collect()}
    for i, text in enumerate(DOCS):
        row, base = found[i], places(text)
        assert row["n_words"] == len(brute.plain_words(text)) and row["n_base"] == len(base)
        assert row["first_word"] == (base[0][0] if base else None)
        assert row["last_word"] == (base[-1][0] if base else None)
        assert row["base_labels"] == ",".join(sorted({label for _, label in base}))
        assert set(row["base_labels"].split(",")) - {""} <= set(row["labels"].split(","))
        assert 0 <= row["score"] <= 1 and (row["score"] == 1 or not base)


def test_notices_with_words_put_in(spark):
    found = {r["id"]: r for r in scan_licenses(documents(spark, DOCS)).collect()}
    whole, edited, part, gpl = (found[len(DOCS) - n] for n in (4, 3, 2, 1))
    assert whole["labels"] == "mit" and whole["score"] == 1.0 and whole["n_base"] == 0
    label, start, end, _ = whole["spans"][0]
    assert (label, start, end) == ("mit", 3000, 3000 + len(template_words(MIT)))
    assert edited["labels"] == "mit" and 0.6 <= edited["score"] < 1
    assert part["labels"] == "" and part["score"] == 0
    assert gpl["labels"] == "gpl-3"


def test_extra_columns_repeated_rows_and_empty_table(spark):
    plain = rows(scan_licenses(documents(spark, DOCS)))
    assert rows(scan_licenses(clashing(documents(spark, DOCS)))) == plain
    assert rows(scan_licenses(documents(spark, DOCS + DOCS, [*range(len(DOCS))] * 2))) == sorted(
        plain * 2, key=repr
    )
    assert rows(scan_licenses(documents(spark, []))) == []
    nulls = documents(spark, DOCS, [None] * len(DOCS))
    assert [r[1:] for r in rows(scan_licenses(nulls))] == sorted((r[1:] for r in plain), key=repr)


def test_a_doubled_text_votes_once(spark):
    twice = scan_licenses(documents(spark, [f"{MIT} {MIT}"])).first()
    assert len(twice["spans"]) == 2 and twice["score"] == 1.0


def test_repeated_words_do_not_cover_a_notice(spark):
    texts_ = ["under cc by " * 3, "under cc by " * 400, "licensed under cc by under cc by nc 4 0"]
    found = [r for r in scan_licenses(documents(spark, texts_)).orderBy("id").collect()]
    assert [(r["labels"], r["score"]) for r in found[:2]] == [("", 0.0)] * 2
    assert found[2]["labels"] == "cc-by-nc"


def plain_alignments(text, notices):
    """For each notice the share of its k-grams in each group of neighbouring diagonals."""
    words, out = brute.plain_words(text), []
    for label, notice in notices:
        own = template_words(notice)
        grams = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
        met = sorted(
            (i - pos, i, pos)
            for i in range(len(words) - 2)
            for pos, gram in enumerate(grams)
            if tuple(words[i : i + 3]) == gram
        )
        groups = []
        for diagonal, i, pos in met:
            if not groups or diagonal - groups[-1][-1][0] > 3:
                groups.append([])
            groups[-1].append((diagonal, i, pos))
        for group in groups:
            start, end = min(i for _, i, _ in group), max(i for _, i, _ in group) + 3
            share = len({pos for *_, pos in group}) / len(grams)
            if share >= 0.6 and 2 * (end - start) <= 3 * len(own):
                out.append((label, start, end, share))
    return sorted(out)


def test_alignments_equal_brute_force(spark):
    more = [f"{prose(3, 9)} {n} {prose(4, 5)} {n} {' '.join(n.split()[2:])}" for _, n in NOTICES]
    found = {r["id"]: r for r in scan_licenses(documents(spark, DOCS + more)).collect()}
    for i, text in enumerate(DOCS + more):
        own = [(s["label"], s["start"], s["end"], s["coverage"]) for s in found[i]["spans"]]
        phrases = [(label, at, at + len(dict(PHRASES)[label].split()), 1.0) for at, label in places(text)]
        assert sorted(own) == sorted(plain_alignments(text, NOTICES) + phrases)
