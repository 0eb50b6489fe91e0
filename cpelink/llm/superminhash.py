"""Near-duplicate grouping by SuperMinHash signatures.

Signature. For every shingle an own random permutation of the components gives
each component a rank; a component's value is the smallest (rank, random
fraction) that any shingle gives it. Ranks of one shingle are all different, so
components are negatively correlated and estimates vary less than with
independent hashes. Ranks are processed level by level for a whole batch, and a
document stops as soon as each component has a value of the current level: later
levels cannot lower it. A document with many more shingles than components needs
two or three levels.

Grouping. Documents with equal shingle sets form one class. Class signatures are
cut into bands; classes that agree in a band share a bucket. The centre of a
bucket is the member with the most company over all its buckets, in a group of
near copies the least edited one, and every other member is compared with it
alone: one pair per member, not one per pair of members. Pairs are verified on
full shingle sets and links grouped by union-find. What a star can miss is a link
between two members of one bucket that still lie in different components. Those
pairs are compared too, except those that cannot link:
- shingles are counted over the members of such buckets. One that nobody else has
  cannot be in an intersection, and with too many of them a member has no partner.
  Pairs that share a rare shingle (at most ``rare`` holders) come from an equi-join
  on it, at most ``rare`` rows each; any other pair intersects in its common
  shingles only, which the edits of a near copy soon leave too few of. More closely:
  of the centre's shingles it has at most those that neither side lacks, counted by bit
  maps of what each lacks, and beyond them at most the frequent ones that either has;
- Jaccard distance is a metric, so two members whose distances to the centre
  differ by more than the limit are further apart than it;
- two bits of each signature component must agree about as often as at the limit
  (6.5 standard deviations of slack, a miss in 1e9), which keeps texts that merely
  share a passage from being compared one by one.
A pair that shares several buckets is taken in the first of them.
All other candidates of the bands are verified, with no cap on buckets or partners.

With 40 bands of 5 a pair at similarity 0.8 fails to share a bucket with
probability 1e-7, at 0.9 with 1e-16.

Defined cases: a null or empty text, or one of white space only, has an empty set
and is linked with nothing; a text of fewer words than a shingle is one shingle of
all its words; a null id sorts below all others and is returned as null; rows
that repeat an id are documents of their own for linking; an empty table gives an
empty result; a very long text is one set of all its shingles. Other columns, whatever
their names, pass through ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release_scratch, scratch_count, ship_package
from .components import connected_components
from .textcols import NULL_ID, ascii_lower, let, row_key, space_words, text_of, upto, without

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_LOST_LONGS = 4    # 64-bit words of the map of what a text lacks of a centre
_LEVEL_SHIFT = 48  # a value: level above, random fraction below


@dataclass(frozen=True)
class NearDup:
    words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 5
    #: Holders up to which a shingle counts as rare among possible partners.
    rare: int = 64
    #: Shingles whose signatures are computed together.
    batch: int = 50_000

    @property
    def longs(self) -> int:
        """64-bit words of one bit plane of the signature."""
        return -(-self.bands * self.rows // 64)

    @property
    def most_unlike(self) -> int:
        """Components that may differ in their two bits between texts that could link."""
        m, q = self.bands * self.rows, (1 - self.percent / 100) * 0.75
        return int(m * q + 6.5 * (m * q * (1 - q)) ** 0.5)


def _salt(k: int) -> np.uint64:
    return np.uint64(k * int(_STEP) % 2 ** 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def signatures(values: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m values for ``n`` sets; ``values`` (uint64) belong to the sets named in ``owner``, which has no empty set."""
    low = np.uint64((1 << _LEVEL_SHIFT) - 1)
    sig = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    perm = first = None
    for level in range(m):
        r = _mix(values + _salt(2 * level + 1))
        swap = level + (((r >> np.uint64(32)) * np.uint64(m - level)) >> np.uint64(32)).astype(np.int64)
        if level == 0:
            rank_of, first = swap, swap
        else:
            at = np.arange(len(values))
            rank_of = perm[at, swap].astype(np.int64)
            perm[at, swap] = perm[:, level]
            perm[:, level] = rank_of
        value = (_mix(values + _salt(2 * level + 2)) & low) | np.uint64(level << _LEVEL_SHIFT)
        np.minimum.at(sig, owner * m + rank_of, value)
        open_ = sig.reshape(n, m).max(axis=1) >= np.uint64((level + 1) << _LEVEL_SHIFT)
        if not open_.any():
            break
        go = open_[owner]
        if level == 0:
            values, owner, first = values[go], owner[go], first[go]
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(values), 1))
            at = np.arange(len(values))
            perm[at, first] = 0
            perm[:, 0] = first
        elif not go.all():
            values, owner, perm = values[go], owner[go], perm[go]
    return sig.reshape(n, m)


def shingle_set(text: Column, k: int) -> Column:
    """Distinct 64-bit hashes of the text's k-word shingles."""
    def of(w: Column) -> Column:
        many = F.array_distinct(F.transform(upto(F.size(w) - (k - 1)),
                                            lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])))
        return F.when(F.size(w) == 0, F.array().cast("array<long>")) \
            .when(F.size(w) < k, F.array(F.xxhash64(w))).otherwise(many)
    return let(space_words(ascii_lower(text)), of)


def sign(docs: DataFrame, id_col: str, text_col: str, p: NearDup) -> DataFrame:
    """(__id, __th, n, k1, k2, bands, bits): set size, 128-bit key of the set, one bucket number per band, and two
    bit planes of the signature."""
    ship_package(docs.sparkSession)
    m = p.bands * p.rows
    text = text_of(text_col)
    sets = docs.select(*row_key(id_col, text), shingle_set(text, p.words).alias("set"))
    names = ["__id", "__th", "n", "k1", "k2", "bands", "bits"]

    def lists(rows: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
        """One list per document: a row of ``rows`` for those with shingles, else empty."""
        ends = np.cumsum(np.where(sizes > 0, rows.shape[1], 0))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()),
                                        pa.array(np.ascontiguousarray(rows).reshape(-1).view(np.int64)))

    def part(b: pa.RecordBatch, lo: int, hi: int, offsets: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(offsets[lo:hi + 1])
        values = flat[offsets[lo]:offsets[hi]]
        full = np.flatnonzero(sizes)
        owner = np.repeat(np.arange(len(full)), sizes[full])
        keys = np.zeros((2, hi - lo), np.uint64)
        buckets, bits = np.zeros((0, p.bands), np.uint64), np.zeros((0, 2 * p.longs), np.uint64)
        if len(full):
            begin = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
            for i, salt in enumerate((np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))):
                keys[i, full] = np.add.reduceat(_mix(values ^ salt), begin)
            sig = signatures(values, owner, len(full), m)
            planes = np.zeros((len(full), 2, p.longs * 64), np.uint8)
            for plane in (0, 1):
                planes[:, plane, :m] = (sig >> np.uint64(plane)) & np.uint64(1)
            bits = np.packbits(planes, axis=2).reshape(len(full), -1).view(np.uint64)
            sig = sig.reshape(len(full), p.bands, p.rows)
            buckets = np.broadcast_to(_mix(np.arange(1, p.bands + 1, dtype=np.uint64)), (len(full), p.bands))
            for row in range(p.rows):
                buckets = _mix(buckets * _STEP + sig[:, :, row])
        return pa.RecordBatch.from_arrays([
            b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(sizes, pa.int64()),
            pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), lists(buckets, sizes),
            lists(bits, sizes)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(2)
            offsets = np.asarray(col.offsets, dtype=np.int64)
            flat = np.asarray(col.values).view(np.uint64)
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + p.batch, side="right")) - 1)
                yield part(b, lo, min(hi, b.num_rows), offsets, flat)
                lo = hi

    return sets.mapInArrow(run, "__id long, __th long, n long, k1 long, k2 long, bands array<long>, bits array<long>")


def _verify(pairs: DataFrame, texts: DataFrame, p: NearDup) -> DataFrame:
    """(a, b, na, nb, inter) of pairs, from the full sets."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")
    counts = let(shingle_set(F.col("ta"), p.words), lambda x: let(shingle_set(F.col("tb"), p.words), lambda y: F.struct(
        F.size(x).cast("long").alias("na"), F.size(y).cast("long").alias("nb"),
        F.size(F.array_intersect(x, y)).cast("long").alias("inter"))))
    return both.select("a", "b", counts.alias("c")).select("a", "b", "c.na", "c.nb", "c.inter")


def _links(tested: DataFrame, p: NearDup) -> DataFrame:
    union = F.col("na") + F.col("nb") - F.col("inter")
    return tested.where(100 * F.col("inter") >= p.percent * union).select("a", "b")


def _texts(docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of one member of each class in ``nodes``."""
    wanted = classes.select("node", "member.__id", "member.__th").join(nodes, "node")
    text = text_of(text_col)
    keyed = docs.select(*row_key(id_col, text), text.alias("text"))
    return keyed.join(wanted, ["__id", "__th"]).dropDuplicates(["node"]).select("node", "text")


def _unlike(x: str, y: str, longs: int) -> Column:
    """Signature components whose two bits differ."""
    parts = [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i))).bitwiseOR(
        F.get(x, F.lit(i + longs)).bitwiseXOR(F.get(y, F.lit(i + longs))))) for i in range(longs)]
    total = parts[0]
    for q in parts[1:]:
        total = total + q
    return total


def _crowded(rows: DataFrame) -> DataFrame:
    """Rows of the buckets that hold more than their centre's component."""
    odd = rows.groupBy("bucket").agg(F.count_if(F.col("label") != F.col("core")).alias("odd"), F.count("*").alias("all"))
    return rows.join(odd.where((F.col("odd") > 0) & (F.col("all") > 1)).select("bucket"), "bucket", "left_semi")


def _rare_shingles(nodes: DataFrame, texts: DataFrame, p: NearDup) -> DataFrame:
    """(node, g, c): the shingles that at most ``p.rare`` of ``nodes`` have, with their number of holders."""
    each = materialize(texts.join(nodes, "node", "left_semi").select(
        "node", F.explode(shingle_set(F.col("text"), p.words)).alias("g")), "crowded_shingles")
    counts = each.groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") <= p.rare)
    return materialize(each.join(materialize(counts, "rare_counts"), "g").select("node", "g", "c"), "rare_shingles")


def _against_centres(rows: DataFrame, rare: DataFrame, texts: DataFrame, p: NearDup) -> DataFrame:
    """(centre, node, lost, frequent): a bit map of the centre's shingles that the node lacks, and how many frequent ones it has beyond the centre's."""
    held = rare.groupBy("node").agg(F.collect_set("g").alias("held"))
    pairs = rows.select("centre", "node").distinct()
    both = (pairs.join(texts.select(F.col("node").alias("centre"), F.col("text").alias("tc")), "centre").join(texts, "node")
            .join(held, "node", "left"))

    def bits(lost: Column) -> Column:
        def word(i: int) -> Column:
            own = F.filter(lost, lambda g: F.floor(F.pmod(g, F.lit(64 * _LOST_LONGS)) / 64) == i)
            return F.aggregate(own, F.lit(0).cast("long"), lambda acc, g: acc.bitwiseOR(
                F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(g, F.lit(64)).cast("int"))))
        return F.array(*[word(i) for i in range(_LOST_LONGS)])

    found = let(shingle_set(F.col("tc"), p.words), lambda c: let(shingle_set(F.col("text"), p.words), lambda x: F.struct(
        bits(F.array_except(c, x)).alias("lost"),
        F.size(F.array_except(F.array_except(x, c), F.coalesce("held", F.array().cast("array<long>")))).cast("long").alias("frequent"))))
    return both.select("centre", "node", found.alias("f")).select("centre", "node", "f.lost", "f.frequent")


def _cross_pairs(rows: DataFrame, tested: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame,
                 p: NearDup) -> DataFrame:
    """Pairs that share a bucket, lie in different components and could link; none of them holds the centre."""
    reach = 1.0 - p.percent / 100.0
    union = F.col("na") + F.col("nb") - F.col("inter")
    from_centre = tested.select(F.col("a").alias("centre"), F.col("b").alias("node"), F.col("na").alias("nc"), F.col("nb").alias("n"),
                                (1.0 - F.col("inter") / union).alias("dist"))
    labelled = (rows.join(from_centre, ["centre", "node"]).join(labels, "node", "left")
                .withColumn("label", F.coalesce("label", "node")))
    centres = labels.select(F.col("node").alias("centre"), F.col("label").alias("core"))
    labelled = (labelled.join(centres, "centre", "left").withColumn("core", F.coalesce("core", "centre"))
                .withColumn("bin", F.floor(F.col("dist") / reach)))
    labelled = materialize(_crowded(labelled), "crowded_rows")
    rare = _rare_shingles(labelled.select("node").distinct(), texts, p)
    held = rare.groupBy("node").agg(F.count("*").alias("rare"), F.count_if(F.col("c") == 1).alias("own"))
    labelled = labelled.join(materialize(held, "rare_held"), "node", "left").na.fill(0, ["rare", "own"]) \
        .where(100 * (F.col("n") - F.col("own")) >= p.percent * F.col("n")) \
        .withColumn("common", F.col("n") - F.col("rare"))
    labelled = materialize(_crowded(labelled).join(classes.select("node", "bits", "bands"), "node"), "open_rows")
    labelled = materialize(labelled.join(_against_centres(labelled, rare, texts, p), ["centre", "node"]), "compared_rows")
    odd = labelled.where(F.col("label") != F.col("core"))
    y = labelled.select(
        "bucket", "bin", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n").alias("mb"),
        F.col("common").alias("sb"), F.col("dist").alias("db"), (F.col("label") == F.col("core")).alias("cb"),
        F.col("bits").alias("yb"), F.col("bands").alias("yl"), F.col("lost").alias("my"), F.col("frequent").alias("fy"))
    x = odd.select("bucket", F.col("node").alias("a"), F.col("label").alias("la"), F.col("n").alias("ma"),
                   F.col("common").alias("sa"), F.col("dist").alias("da"), F.col("bits").alias("xb"), F.col("bands").alias("xl"),
                   F.col("nc"), F.col("lost").alias("mx"), F.col("frequent").alias("fx"),
                   F.explode(F.array(*[F.col("bin") + i for i in (-1, 0, 1)])).alias("bin"))
    near = F.abs(F.col("da") - F.col("db")) <= reach + 1e-9
    alike = (100 + p.percent) * F.least("sa", "sb") >= p.percent * (F.col("ma") + F.col("mb"))
    once = F.col("cb") | (F.col("a") < F.col("b"))
    may = _unlike("xb", "yb", p.longs) <= p.most_unlike
    lost = [F.bit_count(F.get("mx", F.lit(i)).bitwiseOR(F.get("my", F.lit(i)))) for i in range(_LOST_LONGS)]
    most = F.col("nc") - sum(lost[1:], lost[0]) + F.least("fx", "fy")
    shared = (100 + p.percent) * most >= p.percent * (F.col("ma") + F.col("mb"))
    # a pair meets in every bucket that it shares; it could link only if it passes in all of them, so it is taken in the first
    first = F.get(F.array_intersect("xl", "yl"), F.lit(0)) == F.col("bucket")
    by_common = (x.join(y, ["bucket", "bin"]).where((F.col("la") != F.col("lb")) & near & alike & once & may & shared & first)
                 .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = materialize(labelled.select("node", "label", "n", "bits").distinct(), "open_nodes")
    holders = rare.where(F.col("c") > 1).join(nodes.select("node", "label", "n"), "node")
    u = holders.select("g", F.col("node").alias("a"), F.col("label").alias("la"), F.col("n").alias("ma"))
    v = holders.select("g", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n").alias("mb"))
    sized = 100 * F.least("ma", "mb") >= p.percent * F.greatest("ma", "mb")
    by_rare = u.join(v, "g").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & sized).select("a", "b").distinct()
    by_rare = (by_rare.join(nodes.select(F.col("node").alias("a"), F.col("bits").alias("xb")), "a")
               .join(nodes.select(F.col("node").alias("b"), F.col("bits").alias("yb")), "b").where(may).select("a", "b"))
    return by_common.union(by_rare).distinct()


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: NearDup = NearDup()) -> DataFrame:
    """(__id, __th, n, component): one row per document row; the component is its smallest id.

    The result is written; the tables on the way to it are removed.
    """
    mark = scratch_count(docs.sparkSession)
    signed = materialize(sign(docs, id_col, text_col, p), "signatures")
    classes = materialize(
        signed.where(F.col("n") > 0).groupBy("k1", "k2", "n")
        .agg(F.min(F.struct("__id", "__th")).alias("member"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    members = materialize(banded.join(sizes, "bucket"), "bucket_members")
    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    centres = members.join(company, "node").groupBy("bucket").agg(
        F.max_by("node", F.struct("company", -F.col("node"))).alias("centre"))
    rows = materialize(members.select("bucket", "node").join(centres, "bucket")
                       .where(F.col("node") != F.col("centre")), "bucket_rows")
    pairs = materialize(rows.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "star_pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = materialize(_texts(docs, id_col, text_col, classes, nodes), "candidate_texts")
    tested = materialize(_verify(pairs, texts, p), "tested_pairs")
    links = _links(tested, p)
    labels = connected_components(links)
    rest = materialize(_cross_pairs(rows, tested, labels, classes, texts, p), "cross_pairs")
    more = materialize(_links(_verify(rest, texts, p), p), "cross_links")
    if more.limit(1).count():
        labels = connected_components(links.union(more))
    smallest = labels.join(classes.select("node", F.col("member.__id").alias("least")), "node")
    smallest = smallest.join(smallest.groupBy("label").agg(F.min("least").alias("component")), "label")
    key = classes.select("k1", "k2", "n", "node", F.col("member.__id").alias("least")) \
        .join(smallest.select("node", "component"), "node", "left") \
        .select("k1", "k2", "n", F.coalesce("component", "least").alias("component"))
    found = signed.where(F.col("n") > 0).join(key, ["k1", "k2", "n"]).select("__id", "__th", "n", "component")
    alone = signed.where(F.col("n") == 0).select("__id", "__th", "n", F.col("__id").alias("component"))
    out = materialize(found.union(alone), "components")
    release_scratch(docs.sparkSession, since=mark, keep=1)
    return out


def near_dup_report(docs: DataFrame, p: NearDup = NearDup(words=2)) -> DataFrame:
    def shown(c: str) -> Column:
        return F.when(F.col(c) != NULL_ID, F.col(c))
    return group(docs.select("doc_id", "text"), p=p).select(
        shown("__id").alias("doc_id"), F.col("n").alias("n_shingles"), shown("component").alias("component_id"),
        (F.col("__id") == F.col("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         p: NearDup = NearDup()) -> DataFrame:
    """The rows whose id is the smallest of its group, with their columns unchanged."""
    mark = scratch_count(docs.sparkSession)
    gone = materialize(group(docs, id_col, text_col, p).where(F.col("__id") != F.col("component"))
                       .select("__id", "__th").distinct(), "near_duplicates")
    release_scratch(docs.sparkSession, since=mark, keep=1)
    return without(docs, gone, id_col, text_col)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT rn, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT row_number() OVER () AS rn, * FROM documents)),
sets AS (
  SELECT rn, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
         ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
classes AS (SELECT list_sort(s) AS s, min(rn) AS c FROM sets WHERE len(s) > 0 GROUP BY 1),
of_row AS (SELECT rn, doc_id, len(sets.s) AS n, c FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s),
shingles AS (SELECT c, len(s) AS n, unnest(s) AS x FROM classes),
pairs AS (
  SELECT a.c AS a, b.c AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.c <> b.c
  AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
least_id AS (SELECT r.a AS c, min(o.doc_id) AS component_id FROM reach r JOIN of_row o ON o.c = r.b GROUP BY r.a)
SELECT doc_id, n::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       doc_id = coalesce(component_id, doc_id) AS kept
FROM of_row LEFT JOIN least_id USING (c)
"""
