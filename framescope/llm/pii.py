"""Personal data: fixed forms as seeds, and more by patterns of context learned from them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .decontam import T_ARROW
from .text import blocks, mix, one_array, prepare, stored, word_hashes, words_of

# Kinds in their order, and their forms.
KINDS = ("email", "ip", "card", "phone")
LOCAL = r"[A-Za-z0-9._%+-]+"
HOST = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Bootstrapping: rounds; the distinct instances that a pattern needs; the least confidence of a
# pattern and of an instance that is accepted.
ROUNDS = 3
SUPPORT = 3
PATTERN_CONFIDENCE = 0.5
ACCEPTED = 0.8
# Characters looked at on either side of an instance for its two neighbouring words.
REACH = 200
# Patterns that are handed to every task; more are met by a filter of this many bits.
FILTER_BITS = 1 << 27

EMAILS = re.compile(f"{LOCAL}{HOST}")
# Only the start of a run of local characters can begin a match (or the end of the match before).
EMAIL_STARTS = re.compile(f"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{HOST}")
IPS = re.compile(f"(?<![0-9]){IP}")
CARDS = re.compile(CARD)
PHONES = re.compile(PHONE)

# What may be an instance although it lacks the fixed form: mail signs written out or hosts
# without a dot, colon addresses, card and telephone numbers in other spellings.
SIGN = r"(?:@|[\x20]?[\[({][\x20]?(?:at|AT)[\x20]?[\])}][\x20]?|[\x20]at[\x20])"
DOT = r"(?:\.|[\x20]?[\[({][\x20]?(?:dot|DOT)[\x20]?[\])}][\x20]?|[\x20]dot[\x20])"
LOOSE = (
    ("email", re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+(?:@[A-Za-z0-9-]+|{SIGN}[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+)(?![A-Za-z0-9-])")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?(?:[0-9A-Fa-f]{1,4}:?){0,5}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{2,6}(?:[\x20./-]?[0-9]{1,6}){2,8}(?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{2,5}\)?(?:[\x20./-]?\(?[0-9]{2,8}\)?){1,5}(?![0-9A-Za-z])")),
)
DIGITS = {"card": (12, 19), "phone": (7, 15)}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches in linear time."""
    at = 0
    while True:
        found = EMAILS.match(text, at) if at else None
        found = found or EMAIL_STARTS.search(text, at)
        if not found:
            return
        yield found.span()
        at = found.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed forms, ordered; matches that fail a check are dropped."""
    found = []
    if "@" in text:
        found += [(start, 0, end) for start, end in emails(text)]
    if not HAS_DIGIT.search(text):
        return sorted(found)
    for m in IPS.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m.group().split("."))):
            found.append((m.start(), 1, m.end()))
    for m in CARDS.finditer(text):
        digits = only_digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONES.finditer(text):
        if 10 <= len(only_digits(m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


HAS_DIGIT = re.compile("[0-9]")
HAS_MARK = re.compile(r"[0-9@]|[\[({ ]at[\])} ]|[\[({]AT[\])}]")


def loose_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of what may be an instance, apart from ``taken`` and each other.

    The kinds are tried in their order; a place that an earlier kind has is not looked at again.
    """
    if not HAS_MARK.search(text):
        return []
    held = sorted((start, end) for start, _, end in taken)
    found: list[tuple[int, int, int]] = []
    for kind, (name, form) in enumerate(LOOSE):
        starts, new = np.array([s for s, _ in held], np.int64), []
        for m in form.finditer(text):
            start, end = m.span()
            at = int(np.searchsorted(starts, end)) - 1  # the last one held that begins before the end
            if at >= 0 and max(e for _, e in held[max(0, at - 3) : at + 1]) > start:
                continue
            low, high = DIGITS.get(name, (0, end))
            if low <= sum("0" <= c <= "9" for c in m.group()) <= high:
                new.append((start, end))
                found.append((start, kind, end))
        held = sorted(held + new)
    return sorted(found)


def contexts(text: str, start: int, end: int) -> list[int]:
    """Hashes of the two words before, the two after, and one on either side, where they exist.

    Words are runs of other than white space in lower case, and must lie within ``REACH``.
    """
    before, after = text[max(0, start - REACH) : start], text[end : end + REACH]
    left = ascii_lower(before).split()
    right = ascii_lower(after).split()
    if start > REACH:
        left = left[1:]  # perhaps a part of a word
    if end + REACH < len(text):
        right = right[:-1]
    words = [xxhash.xxh3_64_intdigest(w) for w in (left[-2:] + right[:2])]
    n_left, n_right = min(2, len(left)), min(2, len(right))
    pairs = []
    if n_left == 2:
        pairs.append((0, words[0], words[1]))
    if n_left and n_right:
        pairs.append((1, words[n_left - 1], words[n_left]))
    if n_right == 2:
        pairs.append((2, words[-2], words[-1]))
    if not pairs:
        return []
    form, first, second = (np.array(x, np.uint64) for x in zip(*pairs))
    return paired(first, second, form).tolist()


def ascii_lower(text: str) -> str:
    return text.translate(LOWER)


LOWER = {c: c + 32 for c in range(65, 91)}


def paired(first: np.ndarray, second: np.ndarray, form) -> np.ndarray:
    """A hash of two words and the form of the pattern, as signed numbers."""
    return mix(mix(first + np.uint64(1)) + second + mix(np.asarray(form, np.uint64) + np.uint64(7))).view(np.int64)


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


MENTION = (
    T.StructType().add("kind", "integer").add("start", "integer").add("end", "integer")
    .add("instance", "binary").add("seed", "boolean").add("contexts", T.ArrayType(T.LongType()))
)


def mentions(documents: DataFrame) -> DataFrame:
    """Each row's counts, base spans, and mentions: seeds and candidates with their contexts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches):
            rows = []
            for text in one_array(table.column("text")).to_pylist():
                base = base_spans(text)
                listed = [(span, True) for span in base] + [(span, False) for span in loose_spans(text, base)]
                rows.append((
                    [sum(1 for _, k, _ in base if k == kind) for kind in range(4)],
                    hashlib.sha256(spans_text(base).encode()).hexdigest(),
                    spans_text(base),
                    [
                        {"kind": k, "start": s, "end": e, "seed": seed, "contexts": contexts(text, s, e),
                         "instance": xxhash.xxh3_128_digest(ascii_lower(text[s:e]).encode("utf-8", "surrogatepass"))}
                        for (s, k, e), seed in listed
                    ],
                ))
            counts = [pa.array([row[0][kind] for row in rows], pa.int64()) for kind in range(4)]
            yield pa.RecordBatch.from_arrays(
                [one_array(table.column("id")), *counts, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], T_ARROW(schema["mentions"].dataType))],
                ["id", *[f"n_{k}" for k in KINDS], "base_sha256", "base", "mentions"],
            )

    schema = T.StructType([documents.schema["id"]])
    for kind in KINDS:
        schema.add(f"n_{kind}", "long")
    schema.add("base_sha256", "string").add("base", "string").add("mentions", T.ArrayType(MENTION))
    return documents.mapInArrow(read, schema)


def context_counts(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``context, total``: how often each context stands around any one word in all texts.

    The tasks get a bit filter of fixed size of the patterns, so they count and send few
    other contexts, and those fall away in the caller's join.
    """
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in patterns.select(F.pmod("context", F.lit(FILTER_BITS)).alias("bit")).distinct().toLocalIterator():
        bits[row["bit"] >> 3] |= 1 << (row["bit"] & 7)
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for table in blocks(batches, fill=True):
            codes, offsets, words = words_of(one_array(table.column("text")))
            hashed = word_hashes(words)[codes]
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            found = []
            # A word with two before it, one on either side, or two after it.
            for form, first, second in ((0, 0, 1), (1, 0, 2), (2, 1, 2)):
                if len(hashed) > 2:
                    whole = row[2:] == row[:-2]
                    context = paired(hashed[first : len(hashed) - 2 + first][whole], hashed[second : len(hashed) - 2 + second][whole], form)
                    bit = context & (FILTER_BITS - 1)
                    found.append(context[(marks[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1])
            values, times = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(times)], ["context", "n"])

    counted = texts.mapInArrow(count, "context long, n long")
    return counted.groupBy("context").agg(F.sum("n").alias("total"))


def accepted_instances(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``kind, instance`` of the candidates that the learned patterns are sure of.

    Patterns and instances are the two sides of a graph. A pattern's confidence is the share
    of all the words that stand in its context, in all texts, that are instances, each with its
    own confidence; an instance's is that one of its patterns is right. Seeds have 1.
    """
    listed = found.select(F.explode("mentions").alias("x")).select("x.kind", "x.instance", "x.seed", F.explode("x.contexts").alias("context"))
    edges = stored(
        listed.groupBy("kind", "context", "instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n")), "pii_edges"
    )
    nothing = edges.where(F.lit(False)).select("kind", "instance")
    per_pattern = edges.groupBy("kind", "context").agg(
        F.count(F.lit(1)).alias("instances"), F.sum("n").alias("uses"), F.sum(F.col("seed").cast("int")).alias("seeds")
    )
    useful = stored(per_pattern.where((F.col("instances") > F.col("seeds")) & (F.col("instances") >= SUPPORT)), "pii_patterns")
    if useful.isEmpty():  # no context could ever lead from seeds to something new
        return nothing
    totals = context_counts(texts, useful)
    patterns = useful.join(totals, "context", "left").select(
        "kind", "context", F.greatest(F.coalesce("total", F.lit(0)), "uses").alias("total")
    )
    graph = stored(edges.join(patterns, ["kind", "context"]), "pii_graph")
    believed = graph.where("seed").select("kind", "instance", F.lit(1.0).alias("belief")).distinct()
    for _ in range(ROUNDS):
        sure = F.coalesce("belief", F.lit(0.0))
        share = F.sum(F.col("n") * sure) / F.first("total")
        known = F.count_if(sure >= ACCEPTED)
        rated = graph.join(believed, ["kind", "instance"], "left").groupBy("kind", "context").agg(share.alias("share"), known.alias("known"))
        trusted = rated.where((F.col("known") >= SUPPORT) & (F.col("share") >= PATTERN_CONFIDENCE)).select("kind", "context", "share")
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("share"), F.lit(1e-9)))))
        seen = graph.where(~F.col("seed")).join(trusted, ["kind", "context"]).groupBy("kind", "instance").agg((1 - doubt).alias("belief"))
        seeds = graph.where("seed").select("kind", "instance", F.lit(1.0).alias("belief")).distinct()
        believed = stored(seeds.unionAll(seen).groupBy("kind", "instance").agg(F.max("belief").alias("belief")), "pii_beliefs")
    new = believed.where(F.col("belief") >= ACCEPTED).join(graph.where(~F.col("seed")).select("kind", "instance").distinct(), ["kind", "instance"])
    return new.select("kind", "instance")


def find(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Personal data in every whole text: counts of the fixed forms, and all spans.

    Columns: the id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256`` of the
    base spans, ``spans`` (base and learned ones, ``kind:start:end`` in code points, ordered
    by start and kind), ``n_learned``. Mail and IP addresses, card numbers (Luhn) and telephone
    numbers of fixed form are the seeds. The words around them are patterns; the patterns that
    hold mostly identifiers, in all texts, accept candidates of looser form, which make further
    patterns count. Accepted candidates are found wherever they occur. Learned spans overlap no
    base span.

    NULL texts are empty and have no spans. Every row gives a row, repeated rows and NULL ids
    too; copies of a text add no support to a pattern, as it counts distinct instances. Empty
    tables give no rows. Other columns are not read.
    """
    prepare(documents.sparkSession)
    rows = documents.select(documents[id_column].alias("id"), documents[text_column].alias("text"))
    found = stored(mentions(rows).withColumn("row", F.monotonically_increasing_id()), "pii")
    accepted = stored(accepted_instances(rows.select("text"), found), "pii_accepted")
    candidates = found.select("row", F.explode(F.filter("mentions", lambda x: ~x["seed"])).alias("x"))
    learned = candidates.select("row", "x.*").join(accepted, ["kind", "instance"]).groupBy("row").agg(
        F.collect_list(F.struct("start", "kind", "end")).alias("learned")
    )
    open_ = F.exists("mentions", lambda x: ~x["seed"])
    whole = found.where(~open_).withColumns({"spans": F.col("base"), "n_learned": F.lit(0).cast("long")})
    joined = found.where(open_).join(learned, "row", "left").withColumn("learned", F.coalesce("learned", F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    base = F.transform(F.filter("mentions", lambda x: x["seed"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    names = F.array(*[F.lit(kind) for kind in KINDS])
    text = F.transform(
        F.array_sort(F.concat(base, F.col("learned"))), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])
    )
    mixed = joined.withColumns({"spans": F.array_join(text, ","), "n_learned": F.size("learned").cast("long")})
    columns = [F.col("id").alias(id_column), *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_learned"]
    return whole.select(*columns).unionAll(mixed.select(*columns))
