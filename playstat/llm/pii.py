"""Personal data: base formats, and bootstrapped contextual extraction.

Base formats (e-mail, IP, card, phone) are found by rule in every text. They seed
the bootstrap:

* an occurrence is a base span or an identifier-shaped token (it has an ``@`` or
  at least four digits) that no base span touches;
* its lexical patterns are the two words before it, and the word before together
  with the word after, whole words however long or far (words end at white space and
  at the edges of occurrences);
* a pattern's confidence for a kind is the share of that kind among the distinct
  values that it introduces and that speak for or against it, if it introduces enough
  of the kind; values of another kind or without the loose form of this one speak
  against it, unlabelled values with the form do neither;
* an unlabelled occurrence takes a kind when its patterns' joint confidence is
  high and its value has the loose form of that kind (an ``@`` between other
  characters; dotted or coloned groups; 12-19 digits; 7-15 digits).

Spark scores this graph of patterns and occurrences in rounds (distinct values,
partial aggregation, joins on the pattern's hash); new labels support patterns in
the next round, until none is new.

Cases: null text is empty (no spans); copies of a document count once towards a
pattern; repeated rows give a row each; a null doc_id stays null; other columns
are ignored; positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playstat.llm.ragged import slices, text_buffer
from playstat.llm.storage import materialise, table, unused

KINDS = ("email", "ip", "card", "phone")
MIN_VALUES = 5                 # distinct labelled values that a pattern must introduce
MIN_CONFIDENCE = 0.8           # of a pattern
MIN_SCORE = 0.8                # of an occurrence
MERGE = 16                     # rounds whose labels are read as separate tables

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_TRIM = ".,;:!?\"'()[]{}<>"

_FOUND = ("base array<struct<kind:string,start:int,end:int,value:string,fits:array<string>,patterns:array<string>>>, "
          "other array<struct<kind:string,start:int,end:int,value:string,fits:array<string>,patterns:array<string>>>")


def emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        head = text[free:at]
        start = free + len(head.rstrip(_LOCAL))
        free = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", free)
    return found


def ips(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append((at, at + size))
            at += size + 1
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text)
            if m.end() - m.start() <= 37 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]


_RULES = (emails, ips, cards, phones)


_LOOSE = {"email": re.compile(r"[^@]+@[^@]+"), "ip": re.compile(r"[0-9]+(?:[.][0-9]+){3,}|[0-9A-Fa-f]*(?::[0-9A-Fa-f]*){3,}"),
          "card": re.compile(r"[0-9-]+"), "phone": re.compile(r"[0-9()+./-]+")}
_LOOSE_DIGITS = {"email": (0, 80), "ip": (4, 40), "card": (12, 19), "phone": (7, 15)}


def fits(value: str) -> list[str]:
    """Kinds whose loose form an identifier-shaped value has."""
    n = len(_digits(value))
    return [k for k in KINDS if _LOOSE_DIGITS[k][0] <= n <= _LOOSE_DIGITS[k][1] and _LOOSE[k].fullmatch(value)]


class Neighbours:
    """The words of a text beside given places; ``edges`` of occurrences end words too."""

    def __init__(self, text: str, tokens: tuple[array, array], edges: set[int]):
        self.text, (self.starts, self.ends), self.edges = text, tokens, sorted(edges)

    def before(self, place: int) -> tuple[int, int] | None:
        i = bisect_left(self.starts, place) - 1
        if i < 0:
            return None
        end = min(self.ends[i], place)
        edge = bisect_left(self.edges, end) - 1
        return max(self.starts[i], self.edges[edge] if edge >= 0 else 0), end

    def after(self, place: int) -> tuple[int, int] | None:
        i = bisect_right(self.ends, place)
        if i == len(self.starts):
            return None
        start = max(self.starts[i], place)
        edge = bisect_right(self.edges, start)
        return start, min(self.ends[i], self.edges[edge] if edge < len(self.edges) else len(self.text))

    def word(self, span: tuple[int, int] | None, none: str) -> str:
        """Lower-cased, digits masked; a long one by its digest."""
        if span is None:
            return none
        return _key(re.sub(r"[0-9]+", "0", self.text[span[0]:span[1]].strip(_TRIM)))

    def patterns(self, start: int, end: int) -> list[str]:
        """Lexical patterns around a span."""
        near = self.before(start)
        far = self.before(near[0]) if near else None
        one, two, three = self.word(far, "^"), self.word(near, "^"), self.word(self.after(end), "$")
        return [f"{one} {two} _", f"{two} _ {three}"]


def _key(value: str) -> str:
    """What a value or word is compared by: itself, or a digest of all of it if it is long."""
    value = value.lower()
    return value if len(value) <= 64 else hashlib.sha256(value.encode()).hexdigest()


def occurrences(text: str) -> tuple[list[tuple], list[tuple]]:
    """Base spans, and the identifier-shaped tokens beside them, with value, loose kinds and patterns."""
    base = [(kind, a, b) for kind, rule in zip(KINDS, _RULES) for a, b in rule(text)]
    taken = sorted((a, b) for _, a, b in base)
    other, k = [], 0
    tokens = array("q"), array("q")
    for m in _TOKEN.finditer(text):
        token = m.group()
        tokens[0].append(m.start())
        tokens[1].append(m.end())
        if "@" not in token and sum(c in "0123456789" for c in token) < 4:
            continue
        value = token.strip(_TRIM)
        a = m.start() + len(token) - len(token.lstrip(_TRIM))
        b = a + len(value)
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        j = k
        while j < len(taken) and taken[j][0] < b and taken[j][1] <= a:
            j += 1
        if value and (j == len(taken) or taken[j][0] >= b):
            other.append((None, a, b))
    near = Neighbours(text, tokens, {p for _, a, b in base + other for p in (a, b)})
    return tuple([(kind, a, b, _key(text[a:b]), fits(text[a:b]), near.patterns(a, b))
                  for kind, a, b in part] for part in (base, other))


def find(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of docs, ``base`` and ``other`` occurrences of each text."""
    mark = np.zeros(256, bool)
    mark[[ord("@"), *range(ord("0"), ord("9") + 1)]] = True
    keys = ("kind", "start", "end", "value", "fits", "patterns")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                               ("value", pa.string()), ("fits", pa.list_(pa.string())), ("patterns", pa.list_(pa.string()))]))

    def run(batches):
        for b in slices(batches):
            raw, off = text_buffer(b.column("text"))
            seen = np.concatenate(([0], np.cumsum(mark[raw])))
            base, other = [[] for _ in range(b.num_rows)], [[] for _ in range(b.num_rows)]
            for i in np.flatnonzero(seen[off[1:]] > seen[off[:-1]]).tolist():
                one, two = occurrences(raw[off[i]:off[i + 1]].tobytes().decode())
                base[i] = [dict(zip(keys, x)) for x in one]
                other[i] = [dict(zip(keys, x)) for x in two]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(base, kind),
                                              pa.array(other, kind)], [*columns, "base", "other"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return docs.select(*columns, *([] if "text" in columns else ["text"])).mapInArrow(run, f"{kept}, {_FOUND}")


def bootstrap(found: DataFrame) -> DataFrame | None:
    """Labels for the ``other`` occurrences: (pii_key, kind, start, end); None when there is none.

    ``found`` has pii_key, base and other, and is read several times."""
    seen = found.select("pii_key", F.explode(F.concat("base", "other")).alias("o")).select("pii_key", "o.*")
    seen = seen.groupBy("pii_key", "start", "end").agg(*(F.first(c).alias(c) for c in ("kind", "value", "fits", "patterns")))
    seen = materialise(seen, "pii-occurrences")
    labels = seen.where("kind is not null").select("value", "kind", F.lit(False).alias("added")).distinct()
    known = seen.select("pii_key", "start", "end", "value", "fits", F.explode("patterns").alias("pattern"))
    introduced = materialise(known.select("pattern", "value", "fits").distinct(), "pii-introduced")
    rounds = 0
    while True:
        kinds = labels.groupBy("value").agg(F.collect_set("kind").alias("kinds"))
        values = introduced.join(kinds, "value", "left")
        of = {kind: F.coalesce(F.array_contains("kinds", kind), F.lit(False)) for kind in KINDS}
        against = {kind: ~of[kind] & (F.col("kinds").isNotNull() | ~F.array_contains("fits", kind)) for kind in KINDS}
        by_kind = values.groupBy("pattern").agg(F.array(*(
            F.struct(F.lit(kind).alias("label"), F.count_if(of[kind]).alias("n"), F.count_if(against[kind]).alias("against"))
            for kind in KINDS)).alias("by_kind"))
        trusted = (by_kind.select("pattern", F.inline("by_kind")).where(F.col("n") >= MIN_VALUES)
                   .select("pattern", "label", (F.col("n") / (F.col("n") + F.col("against"))).alias("confidence"))
                   .where(F.col("confidence") >= MIN_CONFIDENCE))
        open_ = known.join(labels.select("value").distinct(), "value", "left_anti")
        scored = (open_.join(trusted, "pattern").where(F.array_contains("fits", F.col("label")))
                  .groupBy("pii_key", "start", "end", "value", "label")
                  .agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999)))))).alias("score")))
        fresh = (scored.where(F.col("score") >= MIN_SCORE).groupBy("value").agg(F.max_by("label", F.struct("score", "label")).alias("kind")))
        fresh = materialise(fresh.withColumn("added", F.lit(True)), "pii-round")
        if fresh.isEmpty():
            break
        rounds += 1
        labels = labels.unionByName(fresh)
        if rounds % MERGE == 0:
            labels = materialise(labels, "pii-labels")
    if not rounds:
        return None
    new = labels.where("added").select("value", F.col("kind").alias("label"))
    return seen.where("kind is null").join(new, "value").select("pii_key", F.col("label").alias("kind"), "start", "end")


def _bare(spans: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"),
                                                 x["end"].alias("end")))


def _text_key() -> Column:
    """128 bits that stand for a row's (doc_id, text)."""
    return F.concat_ws(":", F.xxhash64("doc_id", "text"), F.xxhash64("text", "doc_id", F.lit(1)))


def _spans(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, pii_key, base spans) of every row; (pii_key, extra spans) that the bootstrap adds."""
    keyed = docs.select("doc_id", "text", _text_key().alias("pii_key"))
    found = materialise(find(keyed, ["doc_id", "pii_key"]), "pii-found")
    added = bootstrap(found)
    if added is not None:
        added = added.groupBy("pii_key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("extra"))
    return found.select("doc_id", "pii_key", _bare("base").alias("base_spans")), added


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, base_spans and spans: arrays of (kind, start, end) by kind as listed, then start."""
    rows, added = _spans(docs)
    if added is None:
        return rows.select("doc_id", "base_spans", F.col("base_spans").alias("spans"))
    every = F.concat("base_spans", F.coalesce("extra", F.filter("base_spans", lambda x: F.lit(False))))
    return rows.join(added, "pii_key", "left").select("doc_id", "base_spans", in_order(every).alias("spans"))


def in_order(spans: Column) -> Column:
    """By kind as listed, then start."""
    return F.concat(*(F.array_sort(of_kind(spans, kind)) for kind in KINDS))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in angle brackets.

    The base spans are found again in the pass that replaces them, so texts are
    moved only if the bootstrap added spans, to join those."""
    columns = docs.columns
    extra_name, key_name = (unused(name, columns) for name in ("_pii_extra", "_pii_key"))
    _, added = _spans(docs)
    if added is None:
        marked = docs.withColumn(extra_name, F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    else:
        added = added.select(F.col("pii_key").alias(key_name), F.col("extra").alias(extra_name))
        marked = docs.withColumn(key_name, _text_key()).join(added, key_name, "left").select(*columns, extra_name)

    def run(batches):
        for b in slices(batches):
            texts, extra = b.column("text").to_pylist(), b.column(extra_name).to_pylist()
            for i, text in enumerate(texts):
                if not text:
                    continue
                spans = [(a, z, kind) for kind, rule in zip(KINDS, _RULES) for a, z in rule(text)]
                spans += [(x["start"], x["end"], x["kind"]) for x in extra[i] or []]
                out, end = [], 0
                for a, z, kind in sorted(spans, key=lambda x: (x[0], -x[1])):
                    if a >= end:
                        out += [text[end:a], f"<{kind}>"]
                    end = max(end, z)
                if spans:
                    texts[i] = "".join(out) + text[end:]
            new = {c: b.column(c) for c in columns}
            new["text"] = pa.array(texts, new["text"].type)
            if "n_chars" in new:
                new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], new["n_chars"].type)
            yield pa.RecordBatch.from_arrays([new[c] for c in columns], columns)

    return marked.mapInArrow(run, docs.schema)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Contract digest of the spans of all documents."""
    got = extract(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(of_kind(F.col("base_spans"), kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return got.select("doc_id", *counts, F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"),
                      joined(F.col("spans")).alias("spans"))
