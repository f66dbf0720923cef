"""Document fingerprints by winnowing, with DataFrame and SQL functions alone.

A text is a row of units: its words between white space, or, of a run of more than ``LONGEST`` characters, as scripts
without spaces have, its single characters. Each unit is hashed once, and every ``K`` consecutive units get a rolling hash,
the cyclic polynomial ``rotl(h1, K - 1) ^ ... ^ hK``, put together from those of 1, 2 and 4 units. In each window of
``WINDOW`` consecutive hashes the smallest by its leading 40 bits is chosen, of equal ones the rightmost, and kept with its
position. Any passage of ``K + WINDOW - 1`` units that two texts share therefore gives them a print in common, and
between two prints of a text never lie ``WINDOW`` hashes without one.

Sliding minima take two passes of four neighbours each over longs that hold a hash's leading bits above its place, counted
down, so that the least of equal ones is the rightmost.

Defined cases: a null text is an empty one; a text without units has no prints; one of fewer than ``K`` has one, of all its
units; one with fewer than ``WINDOW`` hashes has one window. Likeness is the share of distinct hashes in common (Jaccard),
1 for two texts without prints. ``with_next`` orders rows by descending doc_id, rows without one last, rows of one doc_id by
their text's hash, then their text; the last is followed by the first, a single row by itself; repeated rows are rows of their own. Other
columns of the input are left alone.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sqltext import let, lit

K, WINDOW, LONGEST = 5, 16, 32
#: Low bits of a long that hold a place; texts of more units are walked by blocks.
PLACE = 24
_MASK = (1 << PLACE) - 1
_BLOCK = _MASK - WINDOW
#: Ranges of the order for each partition, so that partitions are alike however ranges fall to them.
RANGES = 8
PRINTS = "array<struct<hash:bigint,pos:int>>"
_INK = r"[^\x20\x09-\x0D]"
_UNIT = rf"(?<!{_INK}){_INK}{{1,{LONGEST}}}+(?!{_INK})|{_INK}"


def _rotated(x: str, by: int) -> str:
    return f"(shiftleft({x}, {by}) | shiftrightunsigned({x}, {64 - by}))"


def _packed(h: str) -> str:
    """For each unit the leading bits of the rolling hash that begins there, above its place counted down; null where K units do not follow."""
    two = f"transform({h}, (x, i) -> {_rotated('x', 1)} ^ get({h}, i + 1))"
    four = lambda a: f"transform({a}, (x, i) -> {_rotated('x', 2)} ^ get({a}, i + 2))"
    return let(let(two, four), lambda b: f"transform({b}, (x, i) -> ({_rotated('x', 1)} ^ get({h}, i + 4)) & {-1 - _MASK}L | ({_MASK} - i))")


def _hash_at(h: str, i: str) -> str:
    """The rolling hash of the K units from a place on."""
    return " ^ ".join([*(_rotated(f"get({h}, {i} + {j})", K - 1 - j) for j in range(K - 1)), f"get({h}, {i} + {K - 1})"])


def _minima(p: str) -> str:
    """Least of each entry and the WINDOW - 1 behind it; what lies behind the end does not count."""
    of = lambda a, by: f"transform({a}, (x, i) -> least(x, get({a}, i + {by}), get({a}, i + {2 * by}), get({a}, i + {3 * by})))"
    return let(of(p, 1), lambda a: of(a, 4))


def prints_sql(text: str) -> str:
    """SQL of ``prints``."""

    def block(h: str) -> str:
        """Places of the minima of all whole windows over units ``h``, or of the one window if they are few."""
        # Minima never move back, so those of windows that reach beyond the end follow the last whole window's.
        whole = lambda m, d: f"slice({d}, 1, cast(array_position({d}, get({m}, greatest(size({h}) - {K + WINDOW - 1}, 0))) as int))"
        kept = let(_packed(h), lambda p: let(_minima(p), lambda m: let(f"array_distinct({m})", lambda d: whole(m, d))))
        return f"transform({kept}, v -> cast({_MASK} - (v & {_MASK}) as int))"

    def chosen(h: str) -> str:
        parts = f"transform(sequence(0, greatest(size({h}) - {K + WINDOW - 1}, 0) div {_BLOCK}), b -> {let(f'slice({h}, b * {_BLOCK} + 1, {_BLOCK + WINDOW + K - 2})', lambda part: f'transform({block(part)}, x -> b * {_BLOCK} + x)')})"
        joined = let(f"flatten({parts})", lambda ps: f"filter({ps}, (x, i) -> i = 0 or x > {ps}[i - 1])")
        places = f"if(size({h}) <= {_BLOCK}, {block(h)}, {joined})"
        return f"transform({places}, x -> named_struct('hash', {_hash_at(h, 'x')}, 'pos', x))"

    def of(h: str) -> str:
        few = f"if(size({h}) = 0, cast(array() as {PRINTS}), array(named_struct('hash', aggregate({h}, 0L, (a, x) -> xxhash64(a, x)), 'pos', 0)))"
        return f"if(size({h}) < {K}, {few}, {chosen(h)})"

    return let(f"transform(regexp_extract_all(coalesce({text}, ''), {lit(_UNIT)}, 0), u -> xxhash64(u))", of)


def prints(text: str) -> Column:
    """array<(hash, pos)> of a text, in order of place; positions count units from 0."""
    return F.expr(prints_sql(text))


def as_text(found: str) -> Column:
    """``hash:position`` of all prints, joined by commas; hashes in hexadecimal digits."""
    return F.expr(f"array_join(transform({found}, x -> concat(hex(x.hash), ':', x.pos)), ',')")


def likeness(a: str, b: str) -> Column:
    """Share of distinct hashes that two arrays of prints have in common."""
    union = f"size(array_union({a}.hash, {b}.hash))"
    return F.expr(f"if(size({a}) + size({b}) = 0, 1D, size(array_intersect({a}.hash, {b}.hash)) / {union})")


#: The place of a row in the order, largest first: doc_id, then 62 bits of its text's hash. It hangs on nothing but the row,
#: since the rows are read several times and come in another order each time; rows of one key and text are alike.
_KEY = T.DecimalType(38, 0)


def _ordered(docs: DataFrame) -> DataFrame:
    low = 1 << 62
    key = F.coalesce(F.col("doc_id").cast(_KEY), F.lit(str(-(1 << 63) - 1)).cast(_KEY)) * F.lit(low).cast(T.DecimalType(19, 0))
    key = (key.cast(_KEY) + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(low)).cast(_KEY)).cast(_KEY)
    return docs.withColumn("__key", key)


def _bucket(bounds: list[int]) -> Column:
    """How many of ascending bounds lie at or below a row's key, by two searches of about sqrt(n) comparisons."""
    side = max(1, int(len(bounds) ** 0.5))
    heads = "array(" + ", ".join(f"cast('{b}' as decimal(38,0))" for b in bounds[::side]) + ")"
    each = "array(" + ", ".join(f"cast('{b}' as decimal(38,0))" for b in bounds) + ")"
    row = f"size(filter({heads}, b -> b <= __key))"
    return F.expr(let(row, lambda r: f"if({r} = 0, 0, ({r} - 1) * {side} + size(filter(slice({each}, ({r} - 1) * {side} + 1, {side}), b -> b <= __key)))"))


def dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows with ``__key`` and ``__bucket``, a range of keys; the first row of a range comes once more as the last of the range before it.

    What the driver sees is one number for each bucket, whose number follows the session's partitions, not the table.
    """
    spark = docs.sparkSession
    rows = _ordered(docs)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    cuts = [k / (RANGES * parts) for k in range(1, RANGES * parts)]
    got = rows.agg(F.percentile_approx(F.col("__key").cast("double"), cuts, 20 * len(cuts))).first()[0] or []
    rows = rows.withColumn("__bucket", _bucket(sorted({int(x) for x in got})) if got else F.lit(0))
    first = {r["__bucket"]: r["top"] for r in rows.groupBy("__bucket").agg(F.max("__key").alias("top")).collect()}
    if not first:
        return rows.withColumn("__guest", F.lit(False)), parts
    # Keys descend, so the range before bucket b is the next larger one that has rows; the largest follows the smallest.
    there = sorted(first)
    before = {b: there[(bisect_left(there, b) + 1) % len(there)] for b in there}
    top = "array(" + ", ".join(f"cast('{first[b]}' as decimal(38,0))" if b in first else "null" for b in range(there[-1] + 1)) + ")"
    to = "array(" + ", ".join(str(before.get(b, 0)) for b in range(there[-1] + 1)) + ")"
    own = "named_struct('b', __bucket, 'guest', false)"
    twice = F.expr(f"if({top}[__bucket] = __key, array({own}, named_struct('b', {to}[__bucket], 'guest', true)), array({own}))")
    return rows.withColumn("__to", F.explode(twice)).select(*docs.columns, "__key", F.col("__to.b").alias("__bucket"), F.col("__to.guest").alias("__guest")), parts


def with_next(docs: DataFrame, per_row: dict[str, Column] | None = None) -> DataFrame:
    """Each row with ``next``, the struct of ``text`` and of the ``per_row`` columns of the document behind it in descending doc_id.

    Texts are shuffled once, by ranges of the order; a range is a sorted stream of rows.
    """
    from pyspark.sql import Window

    rows, parts = dealt(docs)
    rows = rows.repartition(parts, "__bucket")
    for name, made in (per_row or {}).items():
        rows = rows.withColumn(name, made)
    order = Window.partitionBy("__bucket").orderBy("__guest", F.desc("__key"), F.desc("text"))
    ahead = {c: F.lead(c).over(order).alias(f"__next_{c}") for c in ("text", *(per_row or {}))}
    out = rows.select("*", *ahead.values()).where("not __guest")
    return out.withColumn("next", F.struct(*(F.col(f"__next_{c}").alias(c) for c in ahead))).drop("__key", "__bucket", "__guest", *(f"__next_{c}" for c in ahead))


def edited_text(text: str, after: str) -> str:
    """``text`` with its last half replaced by as many code points of the text behind it, or all."""
    half = f"(length({text}) div 2)"
    return f"concat(left({text}, length({text}) - {half}), left({after}, {half}))"


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), {"own": prints("text")})
    rows = rows.withColumn("edited", F.expr(edited_text("text", "next.text"))).withColumn("changed", prints("edited"))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("own").alias("fingerprint"),
        as_text("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"),
        likeness("own", "next.own").alias("near_next"),
    )
