"""Secret scans: key patterns, and sliding-window entropy over candidate strings (operator 5).

All of it is column expressions.  Positions come from a pattern's matches and the pieces between them; entropy moves
along a candidate by adding one character's count and taking one off.  Spans are in code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import unused

SPANS = "array<struct<start:int,end:int,kind:int>>"
#: Windows of a candidate that go by one state.
BLOCK = 512


@dataclass(frozen=True)
class Pattern:
    """Matches of ``regex`` whose ``group`` has ``least`` code points or more."""

    kind: str
    regex: str
    group: int
    least: int


@dataclass(frozen=True)
class EntropyClass:
    """Runs of ``alphabet`` with a window of ``width`` characters that has ``bits`` of entropy a character, and that hold
    something of each of ``needs``."""

    kind: str
    alphabet: str
    width: int
    bits: float
    needs: tuple[str, ...] = ()

    @property
    def regex(self) -> str:
        return f"[{self.alphabet}]{{{self.width},}}"


#: The kinds asked for.
PATTERNS = (
    Pattern("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Pattern("access", "AKIA[A-Z0-9]+", 0, 18),
    Pattern("hex", "[0-9a-f]{16,}", 0, 16),
)
ENTROPY = (
    EntropyClass("entropy_hex", "0-9A-Fa-f", 24, 3.1, ("[0-9]", "[A-Fa-f]")),
    EntropyClass("entropy_base64", "A-Za-z0-9+/_=-", 24, 4.05, ("[0-9]", "[A-Za-z]")),
)
#: Candidates of these forms are no secrets: ids, paths, stated placeholders, and runs of the alphabet or of digits.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^/?[a-z0-9_-]+(/[a-z0-9_-]+){2,}/?$",
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|xxxxxx|000000",
    r"(?i)abcdefgh|01234567|12345678",
)


def _bound(x: Column, f) -> Column:
    """``f`` of a value that is worked out once."""
    return F.get(F.transform(F.array(x), f), 0)


def _running(x: Column, f) -> Column:
    """``f`` (a sum, a greatest) over each element and all before it: every step doubles how far back it reaches."""
    reach = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(x), F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.aggregate(reach, x, lambda acc, d: F.transform(acc, lambda v, i: F.coalesce(f(v, F.get(acc, i - d)), v)))


def _islands(begin: Column, end: Column) -> Column:
    """(a, b) of the stretches that spans cover which come in order of ``begin``; spans that touch are one stretch."""
    kind = "array<struct<a:int,b:int>>"
    both = F.struct(begin.cast("array<int>").alias("begin"), _running(end.cast("array<int>"), F.greatest).alias("far"))

    def of(s: Column) -> Column:
        fresh = F.transform(s["begin"], lambda x, i: (i == 0) | (x > F.get(s["far"], i - 1)))
        return _bound(
            F.struct(s["begin"].alias("begin"), s["far"].alias("far"), fresh.alias("fresh")),
            lambda t: F.zip_with(
                F.filter(t["begin"], lambda x, i: F.get(t["fresh"], i)),
                F.filter(t["far"], lambda x, i: F.coalesce(F.get(t["fresh"], i + 1), F.lit(True))),
                lambda a, b: F.struct(a.alias("a"), b.alias("b")),
            ),
        )

    return F.coalesce(_bound(both, of), F.array().cast(kind)).cast(kind)


def _placed(matches: Column, pieces: Column) -> Column:
    """(start, text) of each match: what stands before it is the pieces and matches before it."""

    def of(s: Column) -> Column:
        sizes = F.zip_with(F.slice(s["p"], 1, F.size(s["m"])), s["m"], lambda p, m: F.length(p) + F.length(m))
        return F.zip_with(_running(sizes, lambda x, y: x + y), s["m"], lambda e, m: F.struct((e - F.length(m)).alias("start"), m.alias("text")))

    return _bound(F.struct(matches.alias("m"), pieces.alias("p")), of)


def pattern_spans(text: Column, p: Pattern, kind: int) -> Column:
    """Spans of a pattern's matches, leftmost first and without overlap; those that fall short are dropped afterwards."""
    regex = F.lit(p.regex)
    found = _placed(F.regexp_extract_all(text, regex, F.lit(0)), F.split(text, p.regex, -1))
    sizes = F.transform(F.regexp_extract_all(text, regex, F.lit(p.group)), F.length)
    spans = F.zip_with(found, sizes, lambda m, n: F.when(n >= p.least, F.struct(m["start"].alias("start"), (m["start"] + F.length(m["text"])).alias("end"), F.lit(kind).alias("kind"))))
    return F.when(text.rlike(p.regex), F.filter(spans, lambda x: x.isNotNull())).otherwise(F.array().cast(SPANS))


def _term(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def _letters(alphabet: str) -> str:
    out, i = "", 0
    while i < len(alphabet):
        if i + 2 < len(alphabet) and alphabet[i + 1] == "-":
            out += "".join(map(chr, range(ord(alphabet[i]), ord(alphabet[i + 2]) + 1)))
            i += 3
        else:
            out += alphabet[i]
            i += 1
    return out


def window_runs(text: Column, c: EntropyClass) -> Column:
    """(a, b) of the stretches of a candidate that windows of enough entropy cover.

    The state is the window's counts, the sum of ``n log2 n`` over them, and the stretches so far; a window's entropy
    is ``log2(width) - sum / width``.  A long candidate goes by blocks of windows, so that the state stays small.
    """
    letters = _letters(c.alphabet)
    chars = F.transform(F.split(text, ""), lambda x: F.instr(F.lit(letters), x))
    w, most = c.width, round(c.width * (log2(c.width) - c.bits), 9)
    runs_kind = "array<struct<a:int,b:int>>"
    begin = F.transform(F.sequence(F.lit(1), F.lit(len(letters))), lambda k: F.lit(0))
    state = F.struct(begin.alias("n"), F.lit(0.0).alias("s"), F.array().cast(runs_kind).alias("runs"))

    def step(acc: Column, x: Column) -> Column:
        come, gone, i = x["come"], x["gone"], x["i"]
        n_in = F.element_at(acc["n"], come)
        out = F.when(gone > 0, F.element_at(acc["n"], F.greatest(gone, F.lit(1)))).otherwise(F.lit(0))
        changed = (F.when(gone > 0, _term(out - 1) - _term(out)).otherwise(F.lit(0.0))) + _term(n_in + 1) - _term(n_in)
        s = F.when(come == gone, acc["s"]).otherwise(acc["s"] + changed)
        n = F.when(come == gone, acc["n"]).otherwise(
            F.transform(acc["n"], lambda v, k: v + F.when(k + 1 == come, 1).otherwise(0) - F.when(k + 1 == gone, 1).otherwise(0))
        )
        hit = (i >= w) & (F.round(s, 9) <= most)
        last = F.get(acc["runs"], F.size(acc["runs"]) - 1)
        joins = F.coalesce(last["b"] >= i - w, F.lit(False))
        longer = F.concat(F.slice(acc["runs"], F.lit(1), F.size(acc["runs"]) - 1), F.array(F.struct(last["a"].alias("a"), i.alias("b"))))
        fresh = F.concat(acc["runs"], F.array(F.struct((i - w).alias("a"), i.alias("b"))))
        runs = F.when(hit & joins, longer).when(hit, fresh).otherwise(acc["runs"])
        return F.struct(n.alias("n"), s.alias("s"), runs.cast(runs_kind).alias("runs"))

    def moves(cs: Column) -> Column:
        return F.transform(cs, lambda v, k: F.struct(v.alias("come"), F.coalesce(F.get(cs, k - w), F.lit(0)).alias("gone"), (k + 1).alias("i")))

    def of_blocks(cs: Column) -> Column:
        def block(k: Column) -> Column:
            runs = F.aggregate(_bound(F.slice(cs, k * BLOCK + 1, F.lit(BLOCK + w - 1)), moves), state, step)["runs"]
            return F.transform(runs, lambda r: F.struct((r["a"] + k * BLOCK).alias("a"), (r["b"] + k * BLOCK).alias("b")))

        last = F.floor(F.greatest(F.size(cs) - w, F.lit(0)) / BLOCK).cast("int")
        return _bound(F.flatten(F.transform(F.sequence(F.lit(0), last), block)), lambda r: _islands(F.transform(r, lambda x: x["a"]), F.transform(r, lambda x: x["b"])))

    return _bound(chars, of_blocks)


def entropy_spans(text: Column, c: EntropyClass, kind: int, allowed: Sequence[str], exact: Sequence[str] = ()) -> Column:
    """Spans of high entropy inside the candidates of one class, without those that the allow-list names."""
    found = _placed(F.regexp_extract_all(text, F.lit(c.regex), F.lit(0)), F.split(text, c.regex, -1))

    def suspect(x: Column) -> Column:
        ok = F.lit(True)
        for need in c.needs:
            ok = ok & x["text"].rlike(need)
        for a in allowed:
            ok = ok & ~x["text"].rlike(a)
        return ok & ~x["text"].isin(*exact) if exact else ok

    spans = F.transform(
        F.filter(found, suspect),
        lambda x: F.transform(window_runs(x["text"], c), lambda r: F.struct((x["start"] + r["a"]).alias("start"), (x["start"] + r["b"]).alias("end"), F.lit(kind).alias("kind"))),
    )
    return F.when(text.rlike(c.regex), F.flatten(spans)).otherwise(F.array().cast(SPANS))


def scan(
    docs: DataFrame, text: str = "text", patterns: Sequence[Pattern] = PATTERNS, entropy: Sequence[EntropyClass] = ENTROPY, allowed: Sequence[str] = ALLOWED, exact: Sequence[str] = ()
) -> DataFrame:
    """All rows and columns, with ``base`` (the patterns' spans) and ``spans`` (these and the entropy spans).

    Spans are (start, end, kind), in order of start and then kind; ``kind`` counts the patterns and then the entropy
    classes.  The allow-list holds for entropy spans alone.  Spans may overlap.  Null and empty texts have no spans;
    repeated rows are each scanned; an empty table gives no rows; no rows move.  Columns called base or spans are
    replaced, all others kept.  The work grows with a text's length and number of matches, by a logarithm more.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = F.concat(*[pattern_spans(t, p, k) for k, p in enumerate(patterns)])
    more = [entropy_spans(t, c, len(patterns) + k, allowed, exact) for k, c in enumerate(entropy)]
    out = docs.withColumn("base", F.array_sort(F.transform(base, _by_start)))
    found = F.array_sort(F.transform(F.concat(F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))), *more), _by_start))
    return out.withColumn("spans", found)


def _by_start(x: Column) -> Column:
    return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))


def listed(spans: Column, kinds: Sequence[str]) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_kind(spans: str, kind: int) -> Column:
    """How many of the spans are of a kind."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def redact(scanned: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same rows with ``mark`` in place of every span; spans that touch become one mark."""
    name = unused(scanned, "runs")
    runs = _islands(F.transform("spans", lambda x: x["start"]), F.transform("spans", lambda x: x["end"]))
    at = scanned.withColumn(name, F.when(F.size("spans") > 0, runs))
    begins = F.concat(F.array(F.lit(0)), F.transform(name, lambda r: r["b"]))
    # The characters are split once, so that a piece costs what it holds.
    chars = F.split(F.col(text), "")
    pieces = _bound(chars, lambda cs: F.zip_with(begins, F.concat(F.transform(name, lambda r: r["a"]), F.array(F.size(cs))), lambda a, b: F.array_join(F.slice(cs, a + 1, b - a), "")))
    return at.withColumn(text, F.when(F.col(name).isNull(), F.col(text)).otherwise(F.array_join(pieces, mark))).drop(name)
