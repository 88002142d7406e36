"""Importance resampling, ranked search and personal data against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from framescope.llm import importance, pii, ranked

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
A_TO_Z = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string"


def words(text):
    return WORD.findall((text or "").translate(A_TO_Z))


def texts(seed, n, size=40):
    rng = random.Random(seed)
    stock = ["Alpha", "beta", "GAMMA", "été", "x1", "漢字", "the", "of", "a", "Ünder"]
    ends = [" ", ", ", "\n", "-", "\x00", "_"]
    found = []
    for _ in range(n):
        weights = [rng.random() ** 3 for _ in stock]
        found.append("".join(rng.choices(stock, weights)[0] + rng.choice(ends) for _ in range(rng.randrange(size))))
    return found


def awkward(spark, rows):
    """The rows among columns with names that the operators use themselves."""
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("id", "h", "m", "bag", "n", "row", "rank", "score", "name", "_salt", "_at", "part", "mentions", "base"):
        frame = frame.selectExpr("*", f"'x' AS {name}")
    return frame


def resampled(docs, target, n, buckets, seed, least, percent):
    def runs(text):
        w = words(text)
        return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    def counts(rows):
        return Counter(zlib.crc32(f.encode()) % buckets for text in rows for f in runs(text))

    s, t = counts(text for _, text in docs), counts(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for doc, text in docs:
        found = runs(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(text))])
    eligible = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = eligible[: percent * len(eligible) // 100]
    return sorted([str(r) for r in rows]), [r[:1] + r[3:4] for r in drawn]


def test_resampling(spark):
    docs = list(enumerate(texts(1, 300))) + [(7, "again the same row " * 9)] * 30 + [(None, "of the"), (901, None), (902, ""), (903, " .. ")]
    target = texts(2, 20) + [None, ""]
    goal = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    for n, buckets in ((1, 10_000), (3, 64)):
        found = importance.resample(awkward(spark, docs).repartition(5), goal, n, buckets, 2024, 20, 10).collect()
        rows, drawn = resampled(docs, target, n, buckets, 2024, 20, 10)
        assert sorted(str([r[c] for c in ("doc_id", "n_features", "weight", "score", "n_words")]) for r in found) == rows
        ranked_rows = sorted((r for r in found if r["rank"] is not None), key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked_rows] == list(range(1, len(drawn) + 1))
        assert [[r["doc_id"], r["score"]] for r in ranked_rows] == drawn


def test_resampling_cuts_long_texts_between_words(monkeypatch):
    text = " ".join(texts(3, 9)).encode()
    whole = [sorted(x for level in importance.features(text, n, importance.Seeds()) for x in level) for n in (1, 2, 4)]
    cut = importance.words_of_bytes
    monkeypatch.setattr(importance, "words_of_bytes", lambda data: cut(data, 16))
    assert [sorted(x for level in importance.features(text, n, importance.Seeds()) for x in level) for n in (1, 2, 4)] == whole


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    some = spark.createDataFrame([(1, "a b")], DOCS)
    assert importance.resample(none, some).collect() == []
    assert importance.resample(some, none).collect()[0]["rank"] is None


def searched(docs, items, k):
    counted = [(doc, Counter(words(text))) for doc, text in docs]
    counted = [(doc, c) for doc, c in counted if c]
    n_docs, terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(words(text))
    rows = []
    for item, asked in wanted.items():
        found = []
        for doc, c in counted:
            m = 50 + 50 * sum(c.values()) * n_docs // terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2.0) / (2 * df[w] + 1.0))) * (10**9 * c[w] // (1000 * c[w] + 20 * m))
                for w in asked
                if c[w]
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        found.sort(key=lambda x: x[:3])
        rows += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(found[:k])]
    return Counter(rows)


def test_search(spark, monkeypatch):
    docs = list(enumerate(texts(4, 200, 12))) + [(1000 + i, "beta the beta x1") for i in range(60)]
    docs += [(5, "beta the beta x1")] * 4 + [(None, "beta the beta x1"), (None, None), (900, ""), (901, "only other words")]
    items = list(enumerate(texts(5, 12, 6))) + [(3, "x1 second text of an item"), (None, "beta"), (77, None), (78, ".."), (79, "absentword")]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS id", "2 AS score")
    frame = awkward(spark, docs).repartition(7).cache()
    for k in (1, 5, 50):
        found = ranked.search(frame, asked, k).collect()
        assert Counter(tuple(r) for r in found) == searched(docs, items, k)
    monkeypatch.setattr(ranked, "CELLS", 64)
    monkeypatch.setattr(ranked, "ADDED", 50)
    monkeypatch.setattr(ranked, "MAX_KEYS", 1)
    assert Counter(tuple(r) for r in ranked.search(frame, asked, 5).collect()) == searched(docs, items, 5)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.search(none, some).collect() == []
    assert ranked.search(spark.createDataFrame([(1, "a b")], DOCS), some.where("false")).collect() == []


FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def passes(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])]
            return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    found = [(m.start(), i, m.end()) for i, (kind, form) in enumerate(FORMS.items()) for m in re.finditer(form, text) if passes(kind, m.group())]
    return sorted(found)


def test_fixed_forms_are_found_as_the_patterns_say():
    rng = random.Random(6)
    stock = ["a", "b.c", "@", "@d", ".", "1", "25", "255", "256", "+", "-", " ", "(4)", "4111111111111111", "é", "%", "\n", "٣", "007"]
    for _ in range(20_000):
        text = "".join(rng.choices(stock, k=rng.randrange(30)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "a@" * 150_000, "a@b" * 100_000, "1:" * 150_000, "a at " * 60_000, "12 " * 100_000):
        pii.loose_spans(text, pii.base_spans(text))


def test_patterns_discover_other_spellings(spark):
    rows = [(i, f"Text {i * 7919} says reach me on line +1 (555) 201-{1000 + i} after lunch today and {'x' * i}") for i in range(12)]
    rows += [(100 + i, f"note {i} so reach me on line 555.201.40{10 + i} after lunch today") for i in range(3)]
    rows += [(200, "elsewhere 555.201.4010 alone"), (201, "a total of 555.201.7777 here"), (202, None), (203, ""), (None, "é +1 (555) 201-3000"), (204, "no data at all")]
    rows += [(300, rows[0][1])] * 20
    found = pii.find(awkward(spark, rows).repartition(6)).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    for doc, text in rows:
        base = ",".join(f"{list(FORMS)[k]}:{s}:{e}" for s, k, e in plain_spans(text or ""))
        assert by_id[doc]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [by_id[doc][f"n_{k}"] for k in FORMS] == [base.count(f"{k}:") for k in FORMS]
    text = rows[12][1]
    at = text.index("555.201")
    assert by_id[100]["spans"] == f"phone:{at}:{at + 12}"
    assert by_id[200]["spans"] == "phone:10:22"  # the same instance in another place
    assert [by_id[i]["spans"] for i in (201, 202, 203, 204)] == [""] * 4
    assert by_id[None]["spans"] == "phone:2:19"
    assert sum(r["n_learned"] for r in found) == 4


def test_personal_data_of_nothing(spark):
    assert pii.find(spark.createDataFrame([], DOCS)).collect() == []


def test_languages_that_have_only_long_texts(spark):
    from framescope.llm import langid

    french = "les rivières débordent après la pluie et la ville attend " * 500
    rows = [(i, french + str(i), "fr") for i in range(6)] + [(100 + i, f"the rivers rise after rain and towns wait {i}", "en") for i in range(6)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(labelled)
    assert model.languages == ["en", "fr"]
    asked = spark.createDataFrame([("la ville attend la pluie",), ("towns wait after rain",), (french,)], "text string")
    assert [r["lang_pred"] for r in langid.predict(asked, model).collect()] == ["fr", "en", "fr"]
