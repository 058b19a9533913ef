"""N-gram Jaccard join by PartEnum signatures.

A document's set is its distinct word shingles (64-bit hashes). Sets are put into
bands by size. Two sets of a band whose similarity reaches the threshold differ in
at most k elements, so of ``n1`` parts of the hash domain, all but k / (k2 + 1) have
at most k2 differences, and within such a part some ``n2 - k2`` of its ``n2``
sub-parts are equal. The signatures of a set are the hashes of its elements in
every such choice of sub-parts: similar sets share one.

A choice that holds no or few elements would be shared by sets that have little in
common. So there are ``x`` parts more than needed, and x + 1 parts agree. A set leaves
out the choices with fewer than m elements, for the largest m up to ``STRONG`` of which
at most x of its parts have any. Of two similar sets, take the one with the larger m:
one of the x + 1 parts has no such choice in it, so the choice that both share there
has m elements or more, and both keep it. No partner is lost.

Signatures lead to candidate groups, not pairs:

1. texts of one set collapse to one node, and groups with equal members to one;
2. every member of a group is compared with its smallest member (a star);
3. linked members are one component. Where a group still holds several components, its
   members meet again, block by block: first their sizes and the parities of their bins,
   whose distance is a lower bound of the difference, and a close one. Members that these leave a possible partner of another
   component then bring their sets, and each unit of work compares them with the partners
   that it has not yet joined. It returns the links of a spanning forest, never pairs: fewer
   rows than it has members.

Comparisons are exact, on whole sets; only documents in candidate pairs move.
Components are then contracted (``components``).

Cases: null or wordless texts have the empty set and are linked with nothing; a text
with fewer words than a shingle is one element; repeated rows give a row each, and
rows that share a doc_id are one document; a null doc_id is its own class, null;
no documents give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playstat.llm.components import components
from playstat.llm.membership import known, marked
from playstat.llm.ragged import SLICE_BYTES, WHITE, Alphabet, Words, give_back, mix, slices, text_buffer, windows
from playstat.llm.storage import materialise, release, table

SHINGLE = 4
PERCENT = 85
BLOCK = 1024                   # members of a group that are compared with as many others at once
BLOCK_ELEMENTS = 500_000       # and elements of their sets, about
_COMPARED = 1 << 17            # words of bins compared at a time
STAR_ROWS = 256                # comparisons with one hub in one place
CARRIED_ROWS = 1_000_000       # rows of one signature that a task holds at most
STRONG = 4                     # elements that a signature's sub-parts should hold
_WIDE = 24                     # differences from which parts are not subdivided
_ALPHABET = Alphabet(WHITE, fold_ascii_case=True)
_U = np.uint64


def shingle_sets(raw: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(raw, off, _ALPHABET)
    grams = windows(words.hash, size)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            yield np.unique(grams[a:b - size + 1])
        elif b > a:
            yield windows(words.hash[a:b], b - a)
        else:
            yield grams[:0]


def parities(elements: np.ndarray) -> bytes:
    """Parity of the elements in each bin of the hash domain, a bit for each bin; two to four
    bins an element. A bin whose parity differs holds a difference of two sets at least."""
    bins = max(64, 1 << (2 * len(elements) - 1).bit_length())
    place = (elements & _U(bins - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bins) & 1).astype(bool)).tobytes()


def folded(bits: list[bytes], width: int) -> np.ndarray:
    """Parities for ``width`` bins, in words of 64, a row for each set."""
    out = np.empty((len(bits), width // 64), np.uint64)
    sizes = np.fromiter(map(len, bits), np.int64, len(bits))
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        rows = np.frombuffer(b"".join([bits[i] for i in own.tolist()]), np.uint64).reshape(len(own), -1)
        while rows.shape[1] > width // 64:
            half = rows.shape[1] // 2
            rows = rows[:, :half] ^ rows[:, half:]
        out[own] = rows
    return out


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


class Bands:
    """Size bands and the shape of their signatures for a threshold in per cent."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.shapes: dict[int, tuple] = {}

    def differences(self, total: int) -> int:
        """Most elements in which similar sets with ``total`` elements together differ."""
        return total * (100 - self.percent) // (100 + self.percent)

    def of(self, n: int) -> Iterator[int]:
        """Upper size bounds of the bands in which a set of size n can be or meet a larger one."""
        top, most = 1, n * 100 // self.percent
        low = 0
        while low < most:
            if top >= n:
                yield top
            low, top = top, max(top + 1, top * 100 // self.percent)

    def shape(self, top: int):
        """(k2, n2, extra parts, part bounds in the hash domain, salts) of a band."""
        if top not in self.shapes:
            k = self.differences(2 * top)
            k2, n2 = (0, 1) if k >= _WIDE else (1, 3)
            need = k // (k2 + 1) + 1
            extra = 1 + need // 6
            parts = (need + extra) * n2
            cuts = np.array([p * (1 << 64) // parts for p in range(1, parts)], _U)
            salt = mix(np.arange(parts, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(top)).reshape(-1, n2)
            self.shapes[top] = (k, k2, n2, extra, cuts, salt)
        return self.shapes[top]

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        """All signatures of a set of sorted hashes."""
        found = []
        total = np.concatenate((np.zeros(1, _U), np.cumsum(mix(elements + _U(0x632BE59BD9B4E019)))))
        for top in self.of(len(elements)):
            k, k2, n2, extra, cuts, salt = self.shape(top)
            if not k:
                continue               # only equal sets, which are one node
            at = np.concatenate(([0], np.searchsorted(elements, cuts), [len(elements)]))
            part, count = np.diff(total[at]).reshape(-1, n2), np.diff(at).reshape(-1, n2)
            if k2:
                part = part.sum(axis=1, keepdims=True, dtype=_U) - part
                count = count.sum(axis=1, keepdims=True) - count
            fewest, least = count.min(axis=1), STRONG
            while np.count_nonzero(fewest < least) > extra:
                least -= 1
            found.append(mix(part + salt)[count >= least])
        return np.concatenate(found) if found else np.empty(0, _U)


def nodes_of(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Written (doc_id, n, node, bins): set size, smallest doc_id of the same set, parities."""
    def run(batches):
        for b in slices(batches):
            rows = []
            for s in shingle_sets(*text_buffer(b.column("text")), size):
                rows.append((len(s), mix(s).sum(dtype=_U), mix(s ^ _U(0xD6E8FEB86659FD93)).sum(dtype=_U),
                             parities(s)))
            n, one, two, bins = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.array(one, _U).view(np.int64)),
                 pa.array(np.array(two, _U).view(np.int64)), pa.array(bins, pa.binary())],
                ["doc_id", "n", "one", "two", "bins"])

    sets = materialise(docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n long, one long, two long, bins binary"), "ngram-sets")
    first = sets.where("n > 0").groupBy("n", "one", "two").agg(F.min("doc_id").alias("node"))
    # written, or the join would share the aggregate's exchange and could not split a large group of copies
    first = materialise(first, "ngram-first")
    nodes = materialise(sets.join(first, ["n", "one", "two"], "left").select(
        "doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"), "bins"), "ngram-nodes")
    release(sets, first)
    return nodes


def candidate_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(grp, doc_id): documents that share a signature; equal groups once."""
    def emit(batches):
        bands, seen = Bands(percent), set()
        for b in slices(batches):
            ids = b.column("doc_id").to_pylist()
            names, found = [], []
            for name, s in zip(ids, shingle_sets(*text_buffer(b.column("text")), size)):
                if name is None or not len(s):
                    continue
                key = int(mix(s).sum(dtype=_U))
                if key in seen:        # copies within a task share all signatures
                    continue
                seen.add(key)
                found.append(bands.signatures(s))
                names.append(np.full(len(found[-1]), name, np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)),
                                                  pa.array(np.concatenate(names))], ["sig", "doc_id"])

    def group(batches):
        sig, doc, streaming = np.empty(0, np.int64), np.empty(0, np.int64), None

        def whole(sig, doc):
            """Groups of complete signature runs; runs with equal members once."""
            start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.empty(0, np.int64)
            if not len(start):
                return
            end = np.concatenate((start[1:], [len(sig)]))
            shared = doc[start] != doc[end - 1]
            if not shared.any():
                return
            key = np.add.reduceat(mix(doc.view(_U)), start)[shared]
            start, end = start[shared], end[shared]
            key, first = np.unique(mix(key + (end - start).astype(_U)), return_index=True)
            length = (end - start)[first]
            at = np.arange(length.sum()) + np.repeat(start[first] - np.cumsum(length) + length, length)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key, length).view(np.int64)), pa.array(doc[at])],
                                             ["grp", "doc_id"])

        for k, b in enumerate(batches):
            if k % 64 == 0:
                give_back()
            sig = np.concatenate((sig, b.column("sig").to_numpy(zero_copy_only=False)))
            doc = np.concatenate((doc, b.column("doc_id").to_numpy(zero_copy_only=False)))
            if not len(sig):
                continue
            last = int(np.searchsorted(sig, sig[-1]))
            if streaming is not None:
                stop = int(np.searchsorted(sig, streaming, "right"))
                yield pa.RecordBatch.from_arrays([pa.array(sig[:stop]), pa.array(doc[:stop])], ["grp", "doc_id"])
                sig, doc, last = sig[stop:], doc[stop:], max(last - stop, 0)
                if not len(sig):
                    continue
                streaming = None
            yield from whole(sig[:last], doc[:last])
            sig, doc = sig[last:], doc[last:]
            if len(sig) > CARRIED_ROWS:
                streaming = sig[0]
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(doc)], ["grp", "doc_id"])
                sig, doc = sig[:0], doc[:0]
        yield from whole(sig, doc)

    signatures = docs.select("doc_id", "text").mapInArrow(emit, "sig long, doc_id long")
    return (signatures.repartition("sig").sortWithinPartitions("sig", "doc_id")
            .mapInArrow(group, "grp long, doc_id long").distinct())


def _close(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and parities leave a link possible."""
    left = info.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bins").alias("ba"))
    right = info.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bins").alias("bb"))

    def run(batches):
        for b in batches:
            na, nb = (b.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            x, y = (b.column(c).to_pylist() for c in ("ba", "bb"))
            width = np.fromiter((8 * min(len(p), len(q)) for p, q in zip(x, y)), np.int64, len(x))
            apart = np.zeros(len(x), np.int64)
            for w in np.unique(width).tolist():
                own = np.flatnonzero(width == w).tolist()
                apart[own] = _apart(folded([x[i] for i in own], w), folded([y[i] for i in own], w))
            yield b.select(["a", "b"]).filter(pa.array(_possible(na, nb, apart, percent)))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ba", "bb") \
        .mapInArrow(run, "a long, b long")


def _possible(na, nb, apart, percent):
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((100 + percent) * apart <= (100 - percent) * (na + nb))


def _units(placed: DataFrame, columns: list[str]) -> DataFrame:
    """Members of a pair of blocks of a group (grp, i, j) next to each other."""
    return (placed.select("grp", "i", "j", "block", *columns).repartition("grp", "i", "j")
            .sortWithinPartitions("grp", "i", "j", "node"))


def _each_unit(batches, lists: set[str]):
    """The columns of one unit at a time; ``lists`` stay Python lists."""
    held, names = None, None
    for b in batches:
        give_back()
        if not b.num_rows:
            continue
        names = b.schema.names
        cols = {c: b.column(c).to_pylist() if c in lists else b.column(c).to_numpy(zero_copy_only=False) for c in names}
        change = np.flatnonzero((np.diff(cols["grp"]) != 0) | (np.diff(cols["i"]) != 0) | (np.diff(cols["j"]) != 0)) + 1
        for x, y in zip([0, *change], [*change, b.num_rows]):
            part = {c: v[x:y] for c, v in cols.items()}
            if held is not None and all(held[c][0] == part[c][0] for c in ("grp", "i", "j")):
                held = {c: held[c] + part[c] if c in lists else np.concatenate((held[c], part[c])) for c in names}
            else:
                if held is not None:
                    yield held
                held = part
    if held is not None:
        yield held


def _possible_pairs(unit: dict, bins: list[bytes], n: np.ndarray, percent: int):
    """(x, y) of members of block i and of block j, in different components, that sizes and
    bins leave possible; a few rows and columns of the square at a time."""
    width = 8 * min(map(len, bins))
    left = np.flatnonzero(unit["block"] == unit["i"][0])
    right = np.flatnonzero(unit["block"] == unit["j"][0])
    side = max(1, int((_COMPARED // (width // 64)) ** 0.5))
    for at in range(0, len(left), side):
        own = left[at:at + side]
        mine = folded([bins[k] for k in own.tolist()], width)
        for to in range(0, len(right), side):
            others = right[to:to + side]
            apart = _apart(mine[:, None], folded([bins[k] for k in others.tolist()], width))
            fits = _possible(n[own][:, None], n[others], apart, percent) \
                & (unit["component"][own][:, None] != unit["component"][others])
            x, y = np.nonzero(fits)
            yield own[x], others[y]


def _links_in_groups(docs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components of each group; written.

    ``members``: grp, node, component, n, bins. A group is cut into blocks, and each
    pair of blocks is one unit of work."""
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_ELEMENTS))).cast("int")
    placed = members.join(members.groupBy("grp").agg(blocks.alias("blocks")), "grp") \
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    def partners(batches):
        """The members of a unit that have a possible partner in it."""
        for u in _each_unit(batches, {"bins"}):
            some = np.zeros(len(u["node"]), bool)
            for x, y in _possible_pairs(u, u["bins"], u["n"], percent):
                some[x] = some[y] = True
            if some.any():
                names = ["grp", "i", "j", "block", "node", "component"]
                yield pa.RecordBatch.from_arrays([pa.array(u[c][some]) for c in names], names)

    meeting = materialise(_units(placed, ["node", "component", "n", "bins"]).mapInArrow(
        partners, "grp long, i int, j int, block int, node long, component long").distinct(), "ngram-meeting")
    content = _contents(docs, meeting.select("node"), size)

    def join(batches):
        for u in _each_unit(batches, {"elements"}):
            sets = [np.frombuffer(e, _U) for e in u["elements"]]
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            root = {c: c for c in u["component"].tolist()}

            def find(c):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            links = []
            for x, y in _possible_pairs(u, [parities(e) for e in sets], n, percent):
                for k, m in zip(x.tolist(), y.tolist()):
                    one, two = find(int(u["component"][k])), find(int(u["component"][m]))
                    if one != two and _similar(sets[k], sets[m], percent):
                        root[max(one, two)] = min(one, two)
                        links.append((int(u["node"][k]), int(u["node"][m])))
            if links:
                a, b = np.array(links, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    found = materialise(_units(meeting.join(content, F.col("node") == F.col("id")), ["node", "component", "elements"])
                        .mapInArrow(join, "a long, b long"), "ngram-more")
    release(meeting, content)
    return found


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _contents(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Written (id, elements): the sets of the wanted documents, once for each task.

    The filter of wanted ids is read where the sets are made: a function of its own
    would be a second Python worker in each task."""
    ids = wanted.toDF("id").distinct()
    shared = marked(ids)

    def sets(batches):
        seen = set()
        some = (b.filter(pa.array(known(shared.value, b.column("doc_id")))) for b in batches)
        for b in slices(some):
            ids, found, fresh = b.column("doc_id").to_pylist(), [], []
            for k, s in enumerate(shingle_sets(*text_buffer(b.column("text")), size)):
                key = ids[k], len(s), int(mix(s).sum(dtype=_U))
                if key not in seen:
                    seen.add(key)
                    fresh.append(ids[k])
                    found.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(fresh, pa.int64()), pa.array(found, pa.binary())], ["id", "elements"])

    made = docs.select("doc_id", "text").mapInArrow(sets, "id long, elements binary")
    return materialise(made.join(ids, "id", "left_semi"), "ngram-contents")


def _links(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, by comparing whole sets.

    The sets of all a's meet the set of their b; a b with many a's is dealt to as many
    places as keeps ``STAR_ROWS`` comparisons in each."""
    pairs = materialise(pairs, "ngram-pairs")

    content = _contents(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), size)
    degree = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(STAR_ROWS)).cast("int").alias("places"))
    dealt = pairs.join(degree, "b").select("b", F.pmod(F.xxhash64("a"), F.col("places")).cast("int").alias("place"), "a")
    rows = dealt.join(content, F.col("a") == F.col("id")).select("b", "place", "a", "elements")
    hubs = dealt.select("b", "place").distinct().join(content, F.col("b") == F.col("id")) \
        .select("b", "place", F.lit(None).cast("long").alias("a"), "elements")

    def compare(batches):
        hub, own = None, []
        for b in slices(batches, "elements", 4 * SLICE_BYTES):
            found = []
            for x, place, a, elements in zip(*(b.column(c).to_pylist() for c in ("b", "place", "a", "elements"))):
                mine = np.frombuffer(elements, _U)
                if a is None:                  # a hub comes before its rows; a repeated id has several sets
                    own = own + [mine] if hub == (x, place) else [mine]
                    hub = (x, place)
                    continue
                if any(_similar(mine, other, percent) for other in own):
                    found.append((a, x))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()),
                                              pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    found = materialise(
        rows.unionByName(hubs).repartition("b", "place").sortWithinPartitions("b", "place", F.col("a").asc_nulls_first())
        .mapInArrow(compare, "a long, b long").distinct(), "ngram-links")
    release(pairs, content)
    return found


def similar(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    nodes = nodes_of(docs, size)
    info = nodes.where("doc_id = node").select("node", "n", "bins").dropDuplicates(["node", "n"])
    to_node = nodes.where("node is not null").select("doc_id", "node").distinct()
    grouped = candidate_groups(docs, size, percent).join(to_node, "doc_id").select("grp", "node").distinct()
    members = materialise(grouped, "ngram-members")
    hubs = members.groupBy("grp").agg(F.min("node").alias("a"), F.max("node").alias("top")).where("a < top")
    star = members.join(hubs, "grp").where("node > a").select(F.col("node").alias("a"), F.col("a").alias("b")).distinct()
    found = _links(docs, _close(star, info, percent), size, percent)
    # rows that share a doc_id are one document
    own = Window.partitionBy("doc_id")
    same = to_node.withColumn("b", F.min("node").over(own)).where("node > b").select(F.col("node").alias("a"), "b")
    links = found.unionByName(same)
    label = materialise(components(links), "ngram-components")

    placed = members.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("grp").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                      F.count("*").alias("size")).where("low < high and size > 2").select("grp")
    rest = placed.join(mixed, "grp", "left_semi").join(info, "node")
    more = _links_in_groups(docs, rest, size, percent)
    if not more.isEmpty():
        label = materialise(components(links.unionByName(more)), "ngram-components")
    release(members, found, more)
    return nodes.join(label, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that are similar to one with a smaller doc_id (in
    the sense of components); rows that repeat a kept doc_id stay."""
    gone = similar(docs, size, percent).where("component_id < doc_id").select("doc_id").distinct()
    # a written table has a size: Spark broadcasts a small one and shuffles by id beyond that
    return docs.join(materialise(gone, "ngram-gone"), "doc_id", "left_anti").select(*docs.columns)


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Contract digest over all documents."""
    return similar(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
both_ AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id r FROM d UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON reach.r = edge.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, min(r) component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON d.doc_id = reach.doc_id GROUP BY ALL
"""
