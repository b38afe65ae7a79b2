"""Markup residue in texts: HTML, Markdown, wiki and LaTeX syntax that an extractor left behind.

The leaf blocks of a text are its lines. Each gets features from its own text (syntax tokens, first and last
characters, word shape), from its neighbours, and from its ancestors, that is the constructs open at the line (a fence,
``pre``, an environment, a table, a template, a list). A linear-chain CRF labels the blocks; it is trained on pages
that were written with known labels (``llm/pages.py``), and decoded by Viterbi. A text has residue if a block of it is
labelled as anything but text. The labels say what a block was, so that headings, lists, code and formulas keep their
structure when the syntax is taken away.

What is no residue: the notation ``- ``, ``_{..}`` and ``^{..}``, and signs that are content, such as comparisons,
prices, paths, intervals, matrices, Miller indices and line formulas of molecules.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.crf import Crf
from corpusloom.llm.pages import CODE, DROP, FORMULA, HEADING, LIST, TABLE, TEXT, pages
from corpusloom.llm.rows import distinct_rows

#: Written pages that the model is trained on, and their seed.
PAGES, SEED = 1500, 11
FEATURES = 1 << 12
LABELS = ["text", "inline", "heading", "list", "code", "formula", "table", "drop"]

# Element names of HTML and of wiki extensions.
_TAGS = (
    "a abbr article aside b big blockquote body br button caption center cite code col dd del div dl dt em figure font footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark math meta nav noscript ol option p pre q "
    "ref references s samp script section select small span strike strong style sub sup svg table tbody td textarea tfoot th thead "
    "title tr tt u ul var video nowiki gallery includeonly noinclude onlyinclude syntaxhighlight poem timeline"
).split()
_URL = r"(?:https?://|www\.|mailto:|/wiki/|#|[\w\-]+(?:/[\w\-.]+)*\.(?:png|jpe?g|svg|gif|webp|html?|md|pdf))[^()\s]*"
TAG = r"</?(?:" + "|".join(_TAGS) + r")(?:\s[^<>]*)?/?>"

#: Syntax tokens inside a line; none of the content signs matches.
TOKENS = {
    "tag": re.compile(TAG, re.I),
    "comment": re.compile(r"<!--|-->"),
    "entity": re.compile(r"&(?:[A-Za-z]{2,8}\d{0,2}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});"),
    "autolink": re.compile(r"<(?:https?|ftp|mailto):[^<>\s]+>"),
    "image": re.compile(r"!\[[^\[\]\n]*\]\([^()\n]*\)"),
    "mdlink": re.compile(r"(?<!!)\[[^\[\]\n]+\]\(" + _URL + r"(?:\s\"[^\"]*\")?\)"),
    "footnote": re.compile(r"\[\^[\w-]+\]:?"),
    "strong": re.compile(r"\*\*(?=[^\s*])[^*\n]*[^\s*]\*\*"),
    "under": re.compile(r"(?<![\w_])__(?=[^\s_])[^\n]*?[^\s_]__(?![\w_])"),
    "strike": re.compile(r"~~(?=[^\s~])[^~\n]*[^\s~]~~"),
    "tick": re.compile(r"(?<!`)`(?=[^`\s])[^`\n]*`(?!`)"),
    "wikilink": re.compile(r"\[\[(?![\d\s,.+-])[^\[\]\n]*\]\]"),
    "template": re.compile(r"\{\{\s*[A-Za-z#][^{}\n]*\}\}"),
    "apostrophes": re.compile(r"(?<!')'{2,5}(?=[^\s'])[^\n]*?[^\s']'{2,5}(?!')"),
    "extlink": re.compile(r"\[https?://[^\s\]]+(?:\s[^\]\n]*)?\]"),
    "command": re.compile(r"(?<![A-Za-z:\\])\\[A-Za-z]{2,}\*?"),
    "spacing": re.compile(r"\\[,;!](?=[\\\w{])|(?<=\w)~\\"),
    "dollar": re.compile(r"\$\$?(?=[^\s$])(?=[^$\n]*[\\_^={}]|[A-Za-z]\$)[^$\n]*[^\s$\\]\$\$?|\$[A-Za-z]\$"),
    "parens": re.compile(r"\\\(.*?\\\)|\\\[.*?\\\]|\\\[\s*$|^\s*\\\]"),
    "magic": re.compile(r"__[A-Z]{4,}__"),
}

#: Syntax that takes a whole line.
LINES = {
    "fence": re.compile(r"^\s*(?:```|~~~)"),
    "atx": re.compile(r"^\s{0,3}#{1,6}\s+\S"),
    "wikihead": re.compile(r"^\s*(={2,6})\s*\S.*?\S?\s*\1\s*$"),
    "rule": re.compile(r"^\s*(?:-{4,}|={4,}|\*{3,}|_{3,})\s*$"),
    "quote": re.compile(r"^\s{0,3}>\s*\S"),
    "task": re.compile(r"^\s*[*+-] \[[ xX]\]\s"),
    "star": re.compile(r"^\s*[*+] \S"),
    "pipe": re.compile(r"^\s*\|.*\|\s*$"),
    "piperule": re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?"),
    "wikitable": re.compile(r"^\s*(?:\{\||\|\}|\|-)"),
    "wikicell": re.compile(r"^\s*(?:!\s\S.*!!|\|\s*\S.*\|\|)"),
    "param": re.compile(r"^\s*\|\s*[\w .-]+\s*=\s*\S?"),
    "opentemplate": re.compile(r"\{\{[^{}]*$"),
    "closetemplate": re.compile(r"^[^{}]*\}\}"),
    "begin": re.compile(r"\\begin\{"),
    "end": re.compile(r"\\end\{"),
    "item": re.compile(r"^\s*\\item\b"),
    "section": re.compile(r"\\(?:sub)*(?:section|paragraph|chapter)\*?\{"),
    "htmlhead": re.compile(r"<h[1-6]\b", re.I),
    "htmllist": re.compile(r"</?(?:ul|ol|li|dl|dt|dd)\b", re.I),
    "htmltable": re.compile(r"</?(?:table|t[rdh]|thead|tbody|caption)\b", re.I),
    "pre": re.compile(r"</?pre\b", re.I),
    "category": re.compile(r"^\W*\[\[(?:Category|File|Image)\s*:", re.I),
}

_OPEN = [
    ("fence", LINES["fence"], LINES["fence"]),
    ("pre", re.compile(r"<(?:pre|syntaxhighlight)\b[^<>]*>", re.I), re.compile(r"</(?:pre|syntaxhighlight)>", re.I)),
    ("comment", re.compile(r"<!--"), re.compile(r"-->")),
    ("formula", re.compile(r"\\begin\{(?:equation|align|gather|displaymath|eqnarray|multline)\*?\}|\\\[(?!.*\\\])|^\s*\$\$\s*$"), re.compile(r"\\end\{(?:equation|align|gather|displaymath|eqnarray|multline)\*?\}|\\\]|^\s*\$\$\s*$")),
    ("list", re.compile(r"\\begin\{(?:itemize|enumerate|description)\}"), re.compile(r"\\end\{(?:itemize|enumerate|description)\}")),
    ("code", re.compile(r"\\begin\{(?:verbatim|lstlisting)\}"), re.compile(r"\\end\{(?:verbatim|lstlisting)\}")),
    ("table", re.compile(r"\{\||<table\b|\\begin\{tabular\}", re.I), re.compile(r"\|\}|</table>|\\end\{tabular\}", re.I)),
    ("template", LINES["opentemplate"], LINES["closetemplate"]),
]
_SIGNS = re.compile(r"[<>\[\]{}|*#`$\\~_&'=^!+-]")


def ancestors(lines: list[str]) -> list[str]:
    """The construct in which each line lies, its first and last line included; none is ''."""
    out, at, close = [], "", None
    last = {name: max((i for i, line in enumerate(lines) if end.search(line)), default=-1) for name, _, end in _OPEN}
    for i, line in enumerate(lines):
        if close is not None:
            out.append(at)
            if close.search(line):
                at, close = "", None
            continue
        here = ""
        if _SIGNS.search(line):
            for name, start, end in _OPEN:
                m = start.search(line)
                if m:
                    here = name
                    if not end.search(line, m.end()) and last[name] > i:
                        at, close = name, end
                    break
        out.append(here)
    return out


def tokens(line: str) -> list[str]:
    """Names of the syntax tokens and line forms that a line has."""
    if not _SIGNS.search(line):
        return []
    return [k for k, p in TOKENS.items() if p.search(line)] + [k for k, p in LINES.items() if p.search(line)]


def _hash(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


_PLAIN = [_hash("bias"), _hash("none")]


def features(lines: list[str]) -> list[list[int]]:
    """Hashed features of each line."""
    found, inside = [tokens(x) for x in lines], ancestors(lines)
    rows = []
    for i, line in enumerate(lines):
        names = ["bias", *(f"has {t}" for t in found[i])]
        if not found[i]:
            names.append("none")
        if inside[i]:
            names += [f"in {inside[i]}", *(f"in {inside[i]} {t}" for t in found[i][:4])]
        if i and inside[i - 1]:
            names.append(f"after {inside[i - 1]}")
        for j, side in ((i - 1, "before"), (i + 1, "next")):
            if 0 <= j < len(lines):
                names += [f"{side} {t}" for t in found[j] if t in ("star", "rule", "wikitable", "fence")]
        s = line.strip()
        if s and not s[0].isalnum():
            names.append(f"first {s[:1]}")
            if s[:2] == "- ":
                names.append("entry")
        if s and found[i] and len(s) < 40:
            names.append("short")
        rows.append([_hash(n) for n in names])
    return rows


def fit(labelled: list[tuple[list[str], list[int]]]) -> Crf:
    """The CRF from labelled pages; deterministic for the same pages."""
    grouped: dict[tuple, list] = {}
    for lines, labels in labelled:
        rows = features(lines)
        key = tuple(map(tuple, rows)), tuple(labels)
        if key in grouped:
            grouped[key][2] += 1.0
        else:
            grouped[key] = [rows, labels, 1.0]
    return Crf(FEATURES, len(LABELS)).fit([(r, g, min(5.0, n)) for r, g, n in grouped.values()])


@cache
def model() -> Crf:
    """The model of the written pages."""
    return fit(pages(PAGES, SEED))


def scores(one: Crf, labelled: list[tuple[list[str], list[int]]]) -> dict[str, float]:
    """F1 of every label on labelled pages."""
    hit, said, true = ([0] * len(LABELS) for _ in range(3))
    for lines, labels in labelled:
        for got, want in zip(one.decode(features(lines)), labels):
            said[got] += 1
            true[want] += 1
            hit[got] += got == want
    return {name: 2 * h / (s + t) if s + t else 1.0 for name, h, s, t in zip(LABELS, hit, said, true)}


# Taking the syntax away.

_COMMANDS = re.compile(r"\\(?:emph|textbf|textit|texttt|text|mathrm|mathbf|mathit|ce|underline|textsc|mbox|operatorname)\{([^{}]*)\}")
_VALUES = re.compile(r"\{\{\s*(?:chem|convert|val|nowrap|lang)\s*\|([^{}]*)\}\}")
_DROPPED = re.compile(r"~?\\(?:cite|ref|label|footnote|vspace|hspace|includegraphics|index)\*?(?:\[[^\]]*\])?\{[^{}]*\}")


def until_stable(change: Callable[[str], str], text: str) -> str:
    """``text`` changed again and again, until nothing new comes of it."""
    seen = set()
    while text not in seen:
        seen.add(text)
        text = change(text)
    return text


def plain(line: str) -> str:
    """A line without inline syntax."""
    line = until_stable(html.unescape, line).replace("\xa0", " ")
    line = re.sub(r"<!--.*?(?:-->|$)|^.*?-->", "", line)
    line = re.sub(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>|<sup\b[^<>]*>\s*\[[^\]]*\]\s*</sup>", "", line, flags=re.I)
    line = re.sub(r"<sub\b[^<>]*>(.*?)</sub>", r"_{\1}", line, flags=re.I)
    line = re.sub(r"<sup\b[^<>]*>(.*?)</sup>", r"^{\1}", line, flags=re.I)
    line = re.sub(r"<(?:br|hr)\b[^<>]*>", " ", line, flags=re.I)
    line = TOKENS["autolink"].sub(lambda m: m.group()[1:-1], line)
    line = TOKENS["tag"].sub("", line)
    line = re.sub(r"\[\[(?:Category|File|Image)\s*:[^\[\]]*\]\]", "", line, flags=re.I)
    line = until_stable(lambda x: TOKENS["template"].sub("", _VALUES.sub(lambda m: " ".join(v for v in m.group(1).split("|") if "=" not in v), x)), line)
    line = re.sub(r"\[\[(?![\d\s,.+-])(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", line)
    line = re.sub(r"!\[([^\[\]]*)\]\([^()]*\)", r"\1", line)
    line = re.sub(r"\[([^\[\]]+)\]\(" + _URL + r"(?:\s\"[^\"]*\")?\)", r"\1", line)
    line = re.sub(r"\[https?://[^\s\]]+\s?([^\]]*)\]", r"\1", line)
    line = TOKENS["footnote"].sub("", line)
    for mark in (r"\*\*", "~~"):
        line = re.sub(mark + r"(?=\S)(.*?\S)" + mark, r"\1", line)
    line = TOKENS["magic"].sub("", line)
    line = re.sub(r"(?<![\w_])__(?=\S)(.*?\S)__(?![\w_])", r"\1", line)
    line = re.sub(r"(?<!`)`(?=[^`\s])([^`]*)`(?!`)", r"\1", line)
    line = re.sub(r"(?<!')'{2,5}(?=[^\s'])(.*?[^\s'])'{2,5}(?!')", r"\1", line)
    line = re.sub(r"\{\\displaystyle\s*((?:[^{}]|\{[^{}]*\})*)\}", r"\1", line)
    line = re.sub(r"\\\(\s*(.*?)\s*\\\)|\\\[\s*(.*?)\s*\\\]", lambda m: m.group(1) or m.group(2) or "", line)
    line = TOKENS["dollar"].sub(lambda m: m.group().strip("$"), line)
    line = _DROPPED.sub("", line)
    line = until_stable(lambda x: _COMMANDS.sub(r"\1", x), line)
    line = re.sub(r"\\[,;!:]\s?", " ", line)
    line = re.sub(r"\\frac\{([^{}]*(?:\{[^{}]*\})?[^{}]*)\}\{([^{}]*(?:\{[^{}]*\})?[^{}]*)\}", r"(\1)/(\2)", line)
    line = re.sub(r"\\(alpha|beta|gamma|delta|Delta|lambda|mu|pi|sigma|omega|theta|rho)\b", lambda m: html.unescape(f"&{m.group(1)};"), line)
    line = re.sub(r"\\(?:begin|end)\{[^{}]*\}", "", line)
    line = re.sub(r"(?<![A-Za-z:\\])\\([A-Za-z]{2,})\*?", r"\1", line)
    return re.sub(r"[ \t]{2,}", " ", line).strip()


def settle(text: str) -> str:
    """A block without the syntax that comes to light when an outer one is gone."""

    def once(x: str) -> str:
        if not any(p.search(x) for p in TOKENS.values()):
            return x
        entry = x.startswith("- ")
        return ("- " if entry else "") + plain(x[2:] if entry else x)

    return until_stable(once, text)


def restructure(lines: list[str], labels: list[int]) -> list[tuple[str, str]]:
    """``(kind, clean text)`` of the blocks of a text; dropped blocks are left out."""
    out: list[tuple[str, str]] = []
    for line, label in zip(lines, labels):
        if label == TEXT:
            out.append(("list" if line.startswith("- ") else "text", line))
            continue
        if label == DROP:
            kept = plain(re.sub(r"\{\{[^{}]*$|^[^{}]*\}\}", "", line)) if not LINES["param"].search(line) else ""
            if kept and not LINES["rule"].search(line) and len(kept) > 3:
                out.append(("text", kept))
            continue
        if label == CODE:
            code = re.sub(r"^\s*(?:```|~~~)\S*\s*$|</?(?:pre|syntaxhighlight)\b[^<>]*>|\\(?:begin|end)\{\w+\}", "", line, flags=re.I)
            if code.strip():
                out.append(("code", "    " + html.unescape(code.rstrip())))
        elif label == FORMULA:
            formula = re.sub(r"\\(?:begin|end)\{\w+\*?\}|\\\[|\\\]|\$\$", "", line).strip()
            if formula:
                out.append(("formula", formula))
        elif label == HEADING:
            head = re.sub(r"^\s*#{1,6}\s+|^\s*={2,6}\s*|\s*={2,6}\s*$", "", line)
            head = re.sub(r"\\(?:sub)*(?:section|paragraph|chapter)\*?\{([^{}]*)\}", r"\1", head)
            if plain(head):
                out.append(("heading", plain(head)))
        elif label == LIST:
            for part in re.split(r"<li\b[^<>]*>|\\item\b", line, flags=re.I):
                entry = plain(re.sub(r"^\s*[*+-] (?:\[[ xX]\]\s)?", "", part))
                if entry:
                    out.append(("list", "- " + entry))
        elif label == TABLE:
            if LINES["wikitable"].search(line) or LINES["piperule"].search(line):
                continue
            cells = re.split(r"\|\||!!|\||</t[dh]>|^\s*!", line, flags=re.I)
            cells = [c for c in map(plain, cells) if c]
            if cells:
                out.append(("table", "\t".join(cells)))
        else:
            text = plain(re.sub(r"^\s{0,3}>\s*", "", line))
            if text:
                out.append(("text", text))
    return out


class Cleaner:
    """Labels and cleans texts with a fitted CRF; remembers decoded feature sequences."""

    def __init__(self, model: Crf) -> None:
        self.model, self.memo = model, {}

    def labels(self, lines: list[str]) -> list[int]:
        rows = features(lines)
        key = tuple(map(tuple, rows)) if len(rows) <= 60 else None
        if key is not None and key in self.memo:
            return self.memo[key]
        out = self.model.decode(rows)
        if key is not None and len(self.memo) < 50_000:
            self.memo[key] = out
        return out

    def clean(self, text: str | None) -> tuple[bool, str | None, list[tuple[str, str]]]:
        """``(has residue, clean text, blocks)``; null and empty texts stay as they are."""
        if not text:
            return False, text, []
        lines = text.split("\n")
        labels = self.labels(lines)
        if all(x == TEXT for x in labels):
            return False, text, [("list" if x.startswith("- ") else "text", x) for x in lines]
        blocks = [(k, t) for k, t in ((k, t if k == "code" else settle(t)) for k, t in restructure(lines, labels)) if t.strip(" \t-'*_~")]
        return True, "\n".join(t for _, t in blocks), blocks


CLEANED = "src string, row_key string, residue boolean, clean_text string, blocks array<struct<kind:string,text:string>>"


def cleaners(df: DataFrame, one: Crf | None) -> Callable[[], Cleaner]:
    """What makes a cleaner in a task; the model is shipped once (under 1 MB, whatever the data)."""
    one = one or model()
    shipped = df.sparkSession.sparkContext.broadcast((one.w, one.t, one.s))

    def make() -> Cleaner:
        own = Crf(1, 1)
        own.w, own.t, own.s = shipped.value
        return Cleaner(own)

    return make


def clean_texts(df: DataFrame, one: Crf | None = None) -> DataFrame:
    """``src, row_key, residue, clean_text, blocks`` of rows with src, row_key and text.

    Null and empty texts come out as they are without residue; repeated rows once; rows with a null key keep it.
    """
    make = cleaners(df, one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cleaner = make()
        for batch in batches:
            done = [cleaner.clean(x) for x in batch.column(2).to_pylist()]
            lists = [[{"kind": k, "text": t} for k, t in d[2]] for d in done]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([d[0] for d in done], pa.bool_()), pa.array([d[1] for d in done], pa.string()), pa.array(lists, pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())])))],
                names=["src", "row_key", "residue", "clean_text", "blocks"],
            )

    return distinct_rows(df.select("src", "row_key", "text")).mapInArrow(run, CLEANED)


def sources(sections: DataFrame, corpus: DataFrame) -> DataFrame:
    """The texts of both tables as src, row_key, text."""
    one = sections.select(F.lit("article_sections").alias("src"), F.col("id").alias("row_key"), "text")
    return one.unionByName(corpus.select(F.lit("corpus").alias("src"), F.col("_id").alias("row_key"), "text"))


def found(sections: DataFrame, corpus: DataFrame, one: Crf | None = None) -> DataFrame:
    """``src, row_key`` of the texts that hold residue; repeated rows count once, null keys never."""
    rows = sources(sections, corpus).where(F.col("row_key").isNotNull() & (F.length("text") > 0))
    make = cleaners(rows, one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cleaner = make()
        for batch in batches:
            hits = [i for i, x in enumerate(batch.column(2).to_pylist()) if any(cleaner.labels(x.split("\n")))]
            yield batch.select(["src", "row_key"]).take(pa.array(hits, pa.int64()))

    return rows.mapInArrow(run, "src string, row_key string").distinct()
