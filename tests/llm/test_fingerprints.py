import hashlib
import random
import re

from labelflow.llm import fingerprints as fp

from .helpers import awkward_rows, frame, prose, same, with_clashes

PIECE = re.compile(r"(?:[^ \t\n\x0b\f\r]+[ \t\x0b\f\r]*){1,%d}" % fp.PIECE_WORDS)


def digests(text):
    return {m.rstrip(" ") for m in PIECE.findall(text)}


def alike(a, b):
    a, b = digests(a), digests(b)
    return 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))


def plain(rows):
    """Edited texts and likenesses from the definition (distinct keys)."""
    order = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in rows))
    out = []
    for i, (has, key, text) in enumerate(order):
        nxt = order[(i + 1) % len(order)][2]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + nxt[:cut]
        out.append((key if has else None, len(text),
                    hashlib.sha256(edited.encode()).hexdigest(),
                    round(alike(text, edited), 9), round(alike(text, nxt), 9)))
    return sorted(out, key=repr)


def _distinct():
    """The awkward rows with a key of their own each (one null key)."""
    rows, seen = [], set()
    for r in awkward_rows():
        if r[0] not in seen:
            seen.add(r[0])
            rows.append(r)
    return rows


def _result(df):
    out = fp.compare_versions(df).select("doc_id", "n_chars", "edited_sha256", "near_edited",
                                         "near_next")
    return sorted(((*r[:3], round(r[3], 9), round(r[4], 9)) for r in map(tuple, out.collect())),
                  key=repr)


def test_equals_brute_force(spark):
    assert _result(frame(spark, _distinct())) == plain(_distinct())


def test_large_differences_are_retried(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(prose(rng, 4).replace("\n", " ") for _ in range(n)), "en", "s", 0)
            for i, n in enumerate([2000, 700, 3, 90, 0, 1200])]
    assert _result(frame(spark, rows)) == plain(rows)


def test_equal_texts_equal_fingerprints_and_sketch_contents(spark):
    table = frame(spark).where("doc_id IS NOT NULL")
    rows = fp.compare_versions(table).collect()
    by_text: dict = {}
    for r in table.collect():
        by_text.setdefault(r["text"] or "", set()).add(r["doc_id"])
    marks = {r["doc_id"]: r["fingerprint"] for r in rows}
    for ids in by_text.values():
        assert len({marks[i] for i in ids}) == 1
    for r in rows:
        cells = re.findall(r"(.{4})(.{16})(.{8})", r["fingerprint"])
        assert len(cells) == fp.TABLES * fp.WIDTH
        n = sum(int(c[0], 16) for c in cells)
        text = next(t for t, ids in by_text.items() if r["doc_id"] in ids)
        assert n == fp.TABLES * len(digests(text))


def test_one_document_is_its_own_next(spark):
    rows = [(7, "abcdefgh", "en", "s", 0)]
    (got,) = fp.compare_versions(frame(spark, rows)).collect()
    assert got["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert got["near_next"] == 1.0


def test_repeated_rows_stay(spark):
    got = fp.compare_versions(frame(spark)).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == \
        sorted((r[0] for r in awkward_rows()), key=repr)


def test_partitioning_does_not_matter(spark):
    same(spark, lambda df: fp.compare_versions(df).select("doc_id", "fingerprint",
                                                          "edited_fingerprint", "near_next"))


def test_empty_table_and_clashing_names(spark):
    assert fp.compare_versions(frame(spark, [])).collect() == []
    assert fp.compare_versions(with_clashes(frame(spark))).count() == len(awkward_rows())
