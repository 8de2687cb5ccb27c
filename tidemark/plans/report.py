"""The report of a run.  Its parts are listed once, with their figures in words, and written out as text or as HTML."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from html import escape
from itertools import chain

from tidemark.functions.places import DISPLAY


@dataclass(frozen=True)
class Wording:
    """What a report says besides its figures."""

    title: str = "Enrollment change report"
    byline: str = ""
    about: str = "A monthly reading of enrollment by county, showing where it declines."
    caveat: str = "Figures cover the tracked program alone; they are a trend, not a headcount."
    context: str = ""
    unit: str = "Total enrollment"
    short: str = "Enrollment"
    problems: str = "Trouble with this run's data; some figures may be missing"
    alerts: str = "New on the watched pages"
    fell: str = "Where enrollment fell most"
    rose: str = "Where enrollment rose most"


@dataclass(frozen=True)
class Figures:
    """A month's figures: ``ranked`` rows have county, now, then, change and pct, in order of decline."""

    month: str
    total: int
    mom: int
    ranked: Sequence[dict]
    alerts: Sequence[str] = ()
    problems: Sequence[str] = ()
    baseline: dict | None = None

    @property
    def declines(self) -> list[dict]:
        return [r for r in self.ranked if r["change"] < 0][:15]

    @property
    def gains(self) -> list[dict]:
        return sorted((r for r in self.ranked if r["change"] > 0), key=lambda r: (-r["change"], r["pct"], r["county"]))[:5]

    @property
    def counts(self) -> str:
        # The words of this count.
        n = [sum(r["change"] < 0 for r in self.ranked), sum(r["change"] > 0 for r in self.ranked)]
        return f"{n[0]} declined, {n[1]} gained, {len(self.ranked) - sum(n)} flat, of {len(self.ranked)}"


@dataclass(frozen=True)
class Lines:
    """Plain lines; the first may be the report's heading."""

    lines: Sequence[str]
    heading: bool = False


@dataclass(frozen=True)
class Notices:
    """What a reader must see first."""

    title: str
    items: Sequence[str]


@dataclass(frozen=True)
class Facts:
    """Named values, each perhaps with the direction that it stands for."""

    values: Sequence[tuple[str, str, int]]


@dataclass(frozen=True)
class Ranking:
    """A table of texts; ``widths`` are those of the columns in plain text, and ``ways`` the rows' directions."""

    title: str
    columns: Sequence[str]
    rows: Sequence[Sequence[str]]
    widths: Sequence[int] = field(default=())
    ways: Sequence[int] = field(default=())


Part = Lines | Notices | Facts | Ranking


def subject(f: Figures, words: Wording = Wording()) -> str:
    moved = format(f.mom, "+,") if f.mom else "no change"
    return ("ALERT: " if f.alerts else "") + f"{words.short} {f.month}: {moved} MoM"


def _percent(x: float) -> str:
    return f"{x:+.1f}%"


def parts(f: Figures, words: Wording = Wording()) -> Iterator[Part]:
    """A report's parts in order: problems and alerts before any figure."""
    yield Lines([x for x in (words.title, words.byline) if x], heading=True)
    yield Lines([words.about])
    yield from (Notices(title, items) for title, items in ((words.problems, f.problems), (words.alerts, f.alerts)) if items)
    facts = [("Data month", f.month, 0), (words.unit, f"{f.total:,}", 0), ("Change vs prior month", f"{f.mom:+,}", f.mom)]
    if f.baseline:
        facts.append((f"Change vs {f.baseline['baseline']} baseline", f"{f.baseline['change']:+,} ({_percent(f.baseline['pct'])})", f.baseline["change"]))
    if f.ranked:
        facts.append(("Counties", f.counts, 0))
    yield Facts(facts)
    shown = lambda r: DISPLAY.get(r["county"], r["county"])
    moves = lambda r: [f"{r['change']:+,}", _percent(r["pct"])]
    if f.declines:
        rows = [[shown(r), f"{r['then']:,}", f"{r['now']:,}", *moves(r)] for r in f.declines]
        yield Ranking(words.fell, ("County", "Prior", "Now", "Change", "%"), rows, (14, 9, 9, 8, 8), [r["change"] for r in f.declines])
    if f.gains:
        yield Ranking(words.rose, ("County", "Change", "%"), [[shown(r), *moves(r)] for r in f.gains], (14, 8, 8), [r["change"] for r in f.gains])
    yield from (Lines([x]) for x in (words.caveat, words.context) if x)


def _as_text(part: Part) -> list[str]:
    match part:
        case Lines(lines):
            return list(lines)
        case Notices(title, items):
            return [f"{title}:", *(f"  - {x}" for x in items)]
        case Facts(values):
            return [f"{name}: {value}" for name, value, _ in values]
        case Ranking(title, columns, rows, widths):
            line = lambda cells: "  " + " ".join(x.rjust(w) if i else x.ljust(w) for i, (x, w) in enumerate(zip(cells, widths, strict=True)))
            return [title, line(columns), *map(line, rows)]


def text(f: Figures, words: Wording = Wording()) -> str:
    """The report as plain text, a blank line between its parts."""
    return "\n\n".join("\n".join(_as_text(p)) for p in parts(f, words))


#: Inline styles by what they are for; mail programs drop style sheets.
STYLE = {
    "page": "font: 15px/1.45 Georgia, serif; max-width: 44em",
    "heading": "font-size: 1.4em; margin: 0 0 .2em",
    "notice": "border: 1px solid #8a6d00; padding: .4em 1em",
    "name": "text-align: left; font-weight: normal; padding-right: 2em",
    "number": "text-align: right; padding-left: 1.5em",
    "caption": "text-align: left; padding: .8em 0 .2em",
}
#: Darker and lighter than the text, so that the sign and not only the colour tells the direction.
WAYS = {-1: "#7a1f3d", 0: "inherit", 1: "#1f5f7a"}


def _tag(name: str, inner: str, style: str = "", way: int = 0) -> str:
    whole = "; ".join(x for x in (STYLE.get(style, ""), f"color: {WAYS[(way > 0) - (way < 0)]}" if way else "") if x)
    return f'<{name} style="{whole}">{inner}</{name}>' if whole else f"<{name}>{inner}</{name}>"


def _as_html(part: Part) -> list[str]:
    safe = lambda x: escape(x, quote=False)
    match part:
        case Lines(lines, heading):
            first = [_tag("h1", safe(lines[0]), "heading")] if heading else []
            return first + [_tag("p", safe(x)) for x in lines[len(first) :]]
        case Notices(title, items):
            return [f'<section style="{STYLE["notice"]}">', _tag("strong", safe(title)), "<ul>", *(_tag("li", safe(x)) for x in items), "</ul>", "</section>"]
        case Facts(values):
            return ["<table>", *(_tag("tr", _tag("th", safe(name), "name") + _tag("td", safe(value), way=way)) for name, value, way in values), "</table>"]
        case Ranking(title, columns, rows, _, ways):
            line = lambda tag, cells, way=0: _tag("tr", "".join(_tag(tag, safe(x), "number" if i else "name", way if i > len(columns) - 3 else 0) for i, x in enumerate(cells)))
            return ["<table>", _tag("caption", safe(title), "caption"), line("th", columns), *(line("td", r, w) for r, w in zip(rows, ways, strict=True)), "</table>"]


def page(f: Figures, words: Wording = Wording()) -> str:
    """The same parts as HTML for mail, a line for each row."""
    body = chain.from_iterable(_as_html(p) for p in parts(f, words))
    return "\n".join([f'<main style="{STYLE["page"]}">', *body, "</main>", ""])
