"""Resolving damaged names against a dimension, and items against a ledger."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import expand_ligatures, norm
from tidemark.sources.scratch import cut

#: A dimension of up to so many names is broadcast; a larger one is joined by keys.
SMALL_DIMENSION = 100_000
#: Up to so many names, all that have a letter are tried for a label; more are met by three letters.
SMALL_THETA = 2_000
#: Names of up to so many characters are looked for by forms, whose bytes grow with the square of a name's length (one edit).
SHORT_NAME = 64
#: More short names than this do not meet one by one where they share two pieces.
CROWD = 256


def _near(dim: DataFrame, size: int | None) -> DataFrame:
    return F.broadcast(dim) if (dim.count() if size is None else size) <= SMALL_DIMENSION else dim


def canonical(rows: DataFrame, dim: DataFrame, label: str, out: str = "name", dim_size: int | None = None) -> DataFrame:
    """Adds the dimension's name whose a-z letters equal the label's; null if there is none."""
    known = _near(dim.select(F.col("norm").alias("_norm"), F.col("name").alias(out)), dim_size)
    return rows.withColumn("_norm", norm(F.col(label))).join(known, "_norm", "left").drop("_norm")


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _letter_bits(word: Column) -> Column:
    """A bit for each of the 26 letters that the word has, and one more for each that it has twice."""
    times = lambda x: F.length(word) - F.length(F.replace(word, F.lit(x), F.lit("")))
    bits = [F.when(times(x) >= t, F.lit(1 << (i + 26 * (t - 1)))).otherwise(F.lit(0)) for i, x in enumerate(LETTERS) for t in (1, 2)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long")


def _triples(word: Column) -> Column:
    """Every three letters that the word has in this order, whatever stands between them."""
    n, at = F.length(word), lambda i: F.substring(word, i, F.lit(1))
    later = lambda i, left: F.when(i < n - left, F.sequence(i + 1, n - left)).otherwise(F.array().cast("array<int>"))
    two = lambda i: F.flatten(F.transform(later(i, 1), lambda j: F.transform(later(j, 0), lambda k: F.concat(at(i), at(j), at(k)))))
    return F.array_distinct(F.flatten(F.transform(later(F.lit(0), 2), two)))


def resolved_labels(labels: DataFrame, dim: DataFrame, label: str = "label", dim_size: int | None = None) -> DataFrame:
    """Distinct labels with ``name`` and ``how`` (exact, prefix, subsequence; null if unresolved).

    Exact matches come first.  What is left, without ligatures and of three letters at least, is a prefix of exactly
    one name, or, if of none, a subsequence of exactly one; anything ambiguous stays unresolved.  Only distinct unresolved
    labels are tried.

    A name that holds a label as a subsequence has all of its letters, as often as the label has them, so a mask of letters
    and doubled letters turns away most names before any pattern is tried.  A small dimension is broadcast and joined by
    a label's first letter.  A larger one is listed under every three letters that a name has in order, and a label is
    looked for under those of its own that the fewest names have: there are 26^3 such counts at most, and no common letter
    brings names and labels together.
    """
    distinct = labels.select(F.col(label).alias(label)).where(F.col(label).isNotNull()).distinct()
    exact = canonical(distinct, dim, label, dim_size=dim_size)
    found = exact.where(F.col("name").isNotNull()).select(label, "name", F.lit("exact").alias("how"))
    probe = norm(expand_ligatures(F.col(label)))
    left = exact.where(F.col("name").isNull()).select(label, probe.alias("probe"))
    tried = left.where(F.length("probe") >= 3)
    pattern = F.array_join(F.split("probe", ""), ".*")
    size = dim.count() if dim_size is None else dim_size
    tried = tried.withColumn("asked", _letter_bits(F.col("probe")))
    known = dim.select(F.col("norm").alias("long"), F.col("name").alias("candidate"), _letter_bits(F.col("norm")).alias("held"))
    if size <= SMALL_THETA:
        names = F.broadcast(known.withColumn("key", F.explode(F.array_distinct(F.split("long", "")))))
        tried = tried.withColumn("key", F.substring("probe", 1, 1))
    else:
        names = known.withColumn("key", F.explode(_triples(F.col("long"))))
        held = F.broadcast(names.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
        own = tried.select("probe").distinct().select("probe", F.explode(_triples(F.col("probe"))).alias("key")).join(held, "key", "left")
        rarest = own.groupBy("probe").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("least"))
        tried = tried.join(rarest.select("probe", F.col("least.key").alias("key")), "probe")
    # A prefix is a subsequence too, so one pass finds both; a probe holds letters alone, so its pattern is safe.
    may = (F.length("long") >= F.length("probe")) & (F.col("held").bitwiseAND(F.col("asked")) == F.col("asked"))
    hits = tried.join(names, "key").where(may).where(F.regexp_like("long", pattern)).withColumn("is_prefix", F.col("long").startswith(F.col("probe")))
    counted = hits.groupBy(label).agg(
        F.count_if("is_prefix").alias("prefixes"),
        F.min(F.when(F.col("is_prefix"), F.col("candidate"))).alias("prefix"),
        F.count(F.lit(1)).alias("subsequences"),
        F.min("candidate").alias("subsequence"),
    )
    by_prefix, by_part = F.col("prefixes") == 1, (F.col("prefixes") == 0) & (F.col("subsequences") == 1)
    fuzzy = counted.select(
        label,
        F.when(by_prefix, F.col("prefix")).when(by_part, F.col("subsequence")).alias("name"),
        F.when(by_prefix, F.lit("prefix")).when(by_part, F.lit("subsequence")).alias("how"),
    ).where(F.col("name").isNotNull())
    known = found.unionByName(fuzzy)
    return distinct.join(known, label, "left")


def canonical_fuzzy(rows: DataFrame, dim: DataFrame, label: str, out: str = "name", dim_size: int | None = None) -> DataFrame:
    """Adds the resolved name of every row's label; each distinct label is resolved once."""
    found = resolved_labels(rows, dim, label, dim_size).select(label, F.col("name").alias(out))
    return rows.join(found, label, "left")


def _piece(name: Column, length: Column, i: Column, n: int, shift: Column) -> Column:
    """Piece ``i`` of ``n`` of a name of ``length``, taken ``shift`` characters further on."""
    begin = F.floor(i * length / n)
    return F.substring(name, (begin + shift + 1).cast("int"), (F.floor((i + 1) * length / n) - begin).cast("int"))


def _fits(length: Column, found: Column, i: Column, n: int, shift: Column) -> Column:
    return (F.floor(i * length / n) + shift >= 0) & (F.floor((i + 1) * length / n) + shift <= found)


def _forms(word: Column, marks: int) -> Column:
    """(s, holes, d): all that up to ``marks`` marks make of a word, where a mark leaves a hole for a character or drops it
    (``d`` are dropped).  Two words within k edits have a form in common whose holes and drops are k at most, and no others have."""
    form = lambda s, holes, d, at: F.struct(s.alias("s"), holes.alias("holes"), d.alias("d"), at.alias("at"))
    last = F.array(form(word, F.array().cast("array<int>"), F.lit(0), F.lit(1)))
    every = [last]

    def marked(f: Column) -> Column:
        def at(i: Column) -> Column:
            before, after = F.substring(f["s"], F.lit(1), i - 1), F.substring(f["s"], i + 1, F.length(f["s"]))
            return F.array(form(F.concat(before, F.lit("*"), after), F.concat(f["holes"], F.array(i)), f["d"], i + 1), form(F.concat(before, after), f["holes"], f["d"] + 1, i))

        places = F.when(f["at"] <= F.length(f["s"]), F.sequence(f["at"], F.length(f["s"]))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(places, at))

    for _ in range(marks):
        last = F.flatten(F.transform(last, marked))
        every.append(last)
    return F.array_distinct(F.transform(F.concat(*every), lambda f: F.struct(f["s"].alias("s"), f["holes"].alias("holes"), f["d"].alias("d"))))


def _by_forms(probes: DataFrame, stock: DataFrame, closeness: int) -> DataFrame:
    """(p, best), as :func:`near_names`: each form keeps the least id of the stock, so no names meet one by one."""
    listed = stock.select("id", F.explode(_forms(F.col("q"), closeness)).alias("f")).groupBy("f.s", "f.holes", F.col("f.d").alias("theirs")).agg(F.min("id").alias("id"))
    sought = probes.select("p", F.explode(_forms(F.col("p"), closeness)).alias("f")).select("p", "f.s", "f.holes", "f.d")
    met = sought.join(listed, ["s", "holes"]).select("p", "id", (F.size("holes") + F.col("d") + F.col("theirs")).alias("edits"))
    return met.where(F.col("edits") <= closeness).groupBy("p").agg(F.min(F.struct("edits", "id")).alias("best"))


def near_names(probes: DataFrame, stock: DataFrame, closeness: int) -> DataFrame:
    """(p, best): for each name ``p`` the least (edits, id) among the names ``q`` of ``stock`` within ``closeness`` edits.

    Names of up to ``SHORT_NAME`` characters are looked for within one edit first, by forms (:func:`_forms`).  What is left is
    met by pieces.  A name is cut into ``closeness`` + 2 pieces of even length.  So many edits leave two pieces as they are,
    and move each by no more characters than there are edits before it.  Every name of the stock is listed under each two of
    its pieces and its length, and is looked for under what a probe has at those places, moved as far as edits allow.  Rows
    and bytes are in proportion to a name's length, whatever the alphabet; names that meet are compared.  Two pieces that
    over ``CROWD`` names share bring none of them together: short names that meet there meet by forms of up to
    ``closeness`` marks instead.  Both tables have a row for each different name.
    """
    short = F.length("p") <= SHORT_NAME
    by_one = min(closeness, 1)
    found = cut(_by_forms(probes.where(short), stock.where(F.length("q") <= SHORT_NAME + by_one), by_one))
    left = probes.join(found.select("p"), "p", "left_anti")
    left = cut(left if closeness > 1 else left.where(~short))
    if left.isEmpty():
        return found
    n, k = closeness + 2, closeness
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    moves = [(a + b + c, a, a + b) for a in range(-k, k + 1) for b in range(-k, k + 1) for c in range(-k, k + 1) if abs(a) + abs(b) + abs(c) <= k]
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])
    asked = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(d).alias("d"), F.lit(x).alias("x"), F.lit(y).alias("y")) for i, j in pairs for d, x, y in moves])
    i, j, none = F.col("at.i"), F.col("at.j"), F.lit(0)
    size = F.length("q")
    listed = stock.select("q", "id", F.explode(places).alias("at")).select("q", "id", F.xxhash64(size, i, j, _piece(F.col("q"), size, i, n, none), _piece(F.col("q"), size, j, n, none)).alias("under"))
    long, x, y = F.length("p"), F.col("at.x"), F.col("at.y")
    size = long - F.col("at.d")
    sought = left.select("p", F.explode(asked).alias("at")).where((size > 0) & _fits(size, long, i, n, x) & _fits(size, long, j, n, y))
    sought = sought.select("p", F.xxhash64(size, i, j, _piece(F.col("p"), size, i, n, x), _piece(F.col("p"), size, j, n, y)).alias("under"))
    may = listed.join(sought.where(short).select("under").distinct(), "under", "left_semi")
    crowds = cut(may.groupBy("under").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("under"))
    calm = sought.where(~short).unionByName(sought.where(short).join(crowds, "under", "left_anti"))
    met = calm.join(listed, "under").select("p", "q", "id").distinct()
    near = [met.withColumn("edits", F.levenshtein("p", "q", k)).where("edits >= 0").groupBy("p").agg(F.min(F.struct("edits", "id")).alias("best"))]
    if not crowds.isEmpty():
        those = lambda t, *c: t.join(crowds, "under", "left_semi").select(*c).distinct()
        near.append(_by_forms(those(sought.where(short), "p"), those(listed.where(F.length("q") <= SHORT_NAME + k), "q", "id"), k))
    rest = reduce(DataFrame.unionByName, near).groupBy("p").agg(F.min("best").alias("best"))
    return found.unionByName(rest)


def match_cascade(items: DataFrame, ledger: DataFrame, material: Sequence[str], closeness: int = 2, item_id: str = "id", url: str = "url", name: str = "name") -> DataFrame:
    """Items with ``matched_id``, ``matched_by`` (id, url, name) and ``status`` (NEW, UPDATE, unchanged).

    The first of these that finds a ledger item wins: equal id; equal url; equal name but for case and other characters
    than letters and digits; a name within ``closeness`` edits of it, the nearest first.  Near-identical names are our
    choice of rule.  Of several, the least id is taken.
    A found item is an UPDATE if any material field differs, null being a value.

    Every item comes out once.  Null ids, urls and names find nothing, nor do names without letters or digits; ledger rows
    without an id are not found.  A ledger that has an id several times counts for it as the row least in its material
    fields.  Names are compared once each, whatever their length and however many items have them.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    item = items.withColumn("_plain", plain(F.col(name)))
    known = ledger.where(F.col(item_id).isNotNull()).withColumn("_plain", plain(F.col(name)))

    def least(key: str, out: str) -> DataFrame:
        return known.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(F.col(key).alias(key)).agg(F.min(item_id).alias(out))

    ids = known.select(F.col(item_id)).distinct().withColumn("_by_id", F.col(item_id))
    named = least("_plain", "_by_name")
    item = item.join(ids, item_id, "left").join(least(url, "_by_url"), url, "left").join(named, "_plain", "left")
    open_ = item.where(F.coalesce("_by_id", "_by_url", "_by_name").isNull() & (F.length("_plain") > 0))
    near = near_names(cut(open_.select(F.col("_plain").alias("p")).distinct()), named.select(F.col("_plain").alias("q"), F.col("_by_name").alias("id")), closeness)
    item = item.join(near.select(F.col("p").alias("_plain"), F.col("best.id").alias("_by_near")), "_plain", "left")
    matched = F.coalesce("_by_id", "_by_url", "_by_name", "_by_near")
    by = F.when(F.col("_by_id").isNotNull(), "id").when(F.col("_by_url").isNotNull(), "url").when(F.coalesce("_by_name", "_by_near").isNotNull(), "name")
    item = item.withColumn("matched_id", matched).withColumn("matched_by", by)
    old = known.groupBy(F.col(item_id).alias("matched_id")).agg(F.min(F.struct(*material)).alias("_old"))
    same = F.lit(True)
    for c in material:
        same = same & F.col(c).eqNullSafe(F.col(f"_old.{c}"))
    status = F.when(F.col("matched_id").isNull(), "NEW").when(same, "unchanged").otherwise("UPDATE")
    out = item.join(old, "matched_id", "left").withColumn("status", status)
    return out.select(*items.columns, "matched_id", "matched_by", "status")


def upsert(sheet: DataFrame, new: DataFrame, key: str, owned: Sequence[str]) -> DataFrame:
    """A sheet's rows with the ``owned`` columns taken from ``new`` where it has them, and new rows added.

    All other columns are left as they are (null in added rows).
    """
    theirs = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in owned])
    joined = sheet.join(theirs, key, "full_outer")
    column = lambda c: F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in owned else F.col(c)
    return joined.select(*[column(c) for c in sheet.columns])


def naming_known(awards: DataFrame, known: DataFrame, award_name: str, known_name: str) -> DataFrame:
    """Awards whose recipient is a known entity, by normalized name."""
    names = known.select(norm(F.col(known_name)).alias("_n")).where("_n <> ''").distinct()
    return awards.withColumn("_n", norm(F.col(award_name))).join(names, "_n", "left_semi").drop("_n")


def tier(*rules: tuple[Column, str], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    out = None
    for test, name in rules:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(otherwise)
