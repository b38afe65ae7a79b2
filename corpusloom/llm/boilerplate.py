"""Main content of web pages by tag-path ratios, and noise lines of extracted sections.

A page is read once into units, the texts between two block-level tags. Text length, punctuation and link text are
aggregated per root-to-leaf tag path; the ratios per path are smoothed over the sequence of units and fused into one
weight, and the block whose own paths gather most weight is the body of the article. Within it, paths below the
threshold (boxes, link lists, odd classes) are taken out again. The places of all units of all pages then teach two
things: a lexicon of masked texts that mostly lie outside the bodies, by a confidence bound, which removes furniture that
a page puts between paragraphs with the very same path; and for each word its odds of standing outside a body.

Sections have no tags; their lines have pseudo-paths (entry or line, end of a sentence, syntax signs, length). The ratio
of a pseudo-path is the share of noise among its lines in all sections: lines that the lexicon lists, and others by the
odds of their words. The ratio is fused with the odds of the words of the line, smoothed over the neighbouring lines,
and lines above the threshold are noise.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.rows import distinct_rows
from corpusloom.session import BROADCAST_BYTES, checkpoint, counted

#: A masked text is furniture if it lies outside the body in more than this share of cases, by the lower confidence
#: bound (Wilson's, at ``Z`` standard deviations).
OUTSIDE, Z = 0.55, 1.645
#: Buckets of the hashed words, and what is added to the counts of each.
BUCKETS, PRIOR = 1 << 16, 2.0
#: What the neighbours of a line add to its score, and the width of a bin of word odds.
SMOOTH, BIN = 0.25, 0.25
#: A nested block is a part of the body only with this share of its text.
SHARE = 0.3

# Inline elements of HTML; all others separate units.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big button cite code data del dfn em font i img input ins kbd label mark nobr q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
VOID = frozenset("br hr meta link base col area param source".split())
FLOW = frozenset("p ul ol li dl dt dd blockquote pre h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BREAKS = HEADINGS | frozenset("p div ul ol dl table blockquote pre section article aside".split())
ASIDE = re.compile(r"^(?:aside|nav|footer|header|form)\b|nav|sidebar|foot|comment|cookie|consent|banner|dialog|notice|widget|share|promo|advert|breadcrumb|menu|catlinks|toc\b|hatnote", re.I)
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*>", re.S | re.I)
MARKS = re.compile(r"(</?[a-zA-Z][^<>]*>)")
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>", re.S)
ATTRIBUTE = re.compile(r"([\w-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？]")
SENTENCE_END = re.compile(r"[.!?:;。！？…][\"”’)\]]*$")
DIGITS = re.compile(r"\d+")
WORDS = re.compile(r"\w+")
NAMES = re.compile(r"\b[A-ZÀ-ÞΑ-ΩА-Я][\w’'-]{5,}")

def mask(text: str) -> str:
    """A text with its numbers and, in longer ones, its names left out."""
    out = DIGITS.sub("0", text)
    return NAMES.sub("N", out) if out.count(" ") >= 3 else out


def hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(mask(text).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def md5(text: str) -> str:
    return digest(text).hex()


_buckets: dict[str, int] = {}


def word_buckets(text: str) -> set[int]:
    """Hashed words of a text; numbers count as one."""
    out = set()
    for w in WORDS.findall(DIGITS.sub("0", text.lower())):
        x = _buckets.get(w)
        if x is None:
            x = zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
            if len(_buckets) < 200_000:
                _buckets[w] = x
        out.add(x)
    return out


class Unit:
    __slots__ = ("links", "linked", "node", "path", "text", "weight")

    def __init__(self, text: str, node: int, linked: int, links: int) -> None:
        self.text, self.node, self.linked, self.links, self.path, self.weight = text, node, linked, links, "", 0.0


class Page:
    """The block tree of a page and its units."""

    _tags: dict[str, tuple] = {}

    def __init__(self, source: str) -> None:
        self.tag, self.sig, self.parent, self.direct, self.children = ["#"], ["#"], [-1], [0], [[]]
        self.units: list[Unit] = []
        self.title = ""
        self._read(source)

    @classmethod
    def _parse(cls, raw: str) -> tuple[int, str, str]:
        """Kind (0 inline, 1 and 2 link opened and closed, 3 no content, 4 opened, 5 closed), name and signature of a tag."""
        m = TAG.match(raw)
        name, closing = m.group(2).lower(), bool(m.group(1))
        sig = name
        if name in INLINE:
            kind = (2 if closing else 1) if name == "a" else 0
        elif name in VOID:
            kind = 3
        else:
            kind = 5 if closing else 4
            if not closing:
                names = sorted(f"{k.lower()}={(a or b or c or '').strip().lower()}" for k, a, b, c in ATTRIBUTE.findall(m.group(3)) if k.lower() not in ("href", "style", "bgcolor", "lang"))
                sig = name + "".join(f"[{x}]" for x in names)
        found = kind, name, sig
        if len(cls._tags) < 20_000:
            cls._tags[raw] = found
        return found

    def _read(self, source: str) -> None:
        known, parse = self._tags, self._parse
        tags, parents = self.tag, self.parent
        at, buffer, links, linked, in_link = 0, [], 0, 0, False
        pieces = MARKS.split(HIDDEN.sub("", source))
        for i, piece in enumerate(pieces):
            if not i & 1:
                if piece:
                    buffer.append(piece)
                    if in_link:
                        linked += len(piece)
                continue
            kind, name, sig = known.get(piece) or parse(piece)
            if kind < 3:
                if kind:
                    in_link = kind == 1
                    links += in_link
                continue
            if buffer:
                self._flush(buffer, at, linked, links)
                buffer, links, linked = [], 0, 0
            in_link = False
            if kind == 3:
                continue
            if kind == 5:
                x = at
                while x > 0 and tags[x] != name:
                    x = parents[x]
                if x > 0 and not (name in FLOW and x != at and self._outside(at, x)):
                    at = parents[x]
                continue
            inner = tags[at]
            if (inner == "p" or inner in HEADINGS) and name in BREAKS:
                at = parents[at]
            if name == "li":
                at = self._leave(at, ("li",), ("ul", "ol"))
            elif name in ("td", "th"):
                at = self._leave(at, ("td", "th"), ("table",))
            elif name == "tr":
                at = self._leave(at, ("tr",), ("table",))
            elif name in ("dt", "dd"):
                at = self._leave(at, ("dt", "dd"), ("dl",))
            tags.append(name)
            self.sig.append(sig)
            parents.append(at)
            self.direct.append(0)
            self.children.append([])
            self.children[at].append(len(tags) - 1)
            at = len(tags) - 1
        if buffer:
            self._flush(buffer, at, linked, links)

    def _outside(self, at: int, x: int) -> bool:
        """Whether a table cell or other closed-off block lies between: a stray end tag does not reach beyond it."""
        while at != x:
            if self.tag[at] in ("td", "th", "div", "article", "section"):
                return True
            at = self.parent[at]
        return False

    def _leave(self, at: int, same: tuple, stop: tuple) -> int:
        x = at
        while x > 0 and self.tag[x] not in stop:
            if self.tag[x] in same:
                return self.parent[x]
            x = self.parent[x]
        return at

    def _flush(self, buffer: list[str], at: int, linked: int, links: int) -> None:
        text = "".join(buffer)
        text = " ".join((html.unescape(text) if "&" in text else text).split())
        if not text:
            return
        if self.tag[at] == "title":
            self.title = self.title or text
            return
        x = at
        while x > 0:
            if self.tag[x] == "head":
                return
            x = self.parent[x]
        self.direct[at] += 1
        self.units.append(Unit(text, at, min(linked, len(text)), links))

    def path(self, node: int) -> str:
        steps = []
        while node > 0:
            steps.append(self.sig[node])
            node = self.parent[node]
        return ">".join(reversed(steps))


def body(source: str | None) -> list[tuple[str, bool]]:
    """``(text, in the body)`` of every unit of a page; none for null and empty pages."""
    if not source:
        return []
    page = Page(source)
    units = page.units
    if not units:
        return []
    paths: dict[int, str] = {}
    sums: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
    for u in units:
        if u.node not in paths:
            paths[u.node] = page.path(u.node)
        u.path = paths[u.node]
        s = sums[u.path]
        s[0] += 1
        s[1] += len(u.text) - u.linked
        s[2] += len(PUNCTUATION.findall(u.text))
        s[3] += u.linked > 0.7 * len(u.text)
    # ratios by path, smoothed over the units of the page, and fused
    length = [sums[u.path][1] / sums[u.path][0] for u in units]
    marks = [sums[u.path][2] / sums[u.path][0] for u in units]
    kernel = (0.25, 0.5, 0.25)
    for i, u in enumerate(units):
        a, b = max(0, i - 1), min(len(units) - 1, i + 1)
        u.weight = ((kernel[0] * length[a] + kernel[1] * length[i] + kernel[2] * length[b]) * (1 + kernel[0] * marks[a] + kernel[1] * marks[i] + kernel[2] * marks[b])) ** 0.5
    # the block whose own paths gather most weight
    title = re.split(r"\s+[-–—|·]\s+(?=[^-–—|·]*$)", page.title)[0].strip() if page.title else ""
    own: dict[int, int] = {}

    def container(node: int) -> int:
        """The block of which a unit is an immediate piece."""
        if node in own:
            return own[node]
        x = node
        while x > 0 and (page.tag[x] in FLOW or (page.direct[x] == 1 and not page.children[x] and page.tag[x] not in ("td", "th", "body", "article", "main"))):
            x = page.parent[x]
        own[node] = x
        return x

    credit: dict[int, float] = defaultdict(float)
    with_title: set[int] = set()
    for u in units:
        x = container(u.node)
        size = len(u.text)
        if size - u.linked > 0.5 * size or (u.links <= 1 and size > 60):
            credit[x] += u.weight * size
        if title and u.text == title:
            with_title |= {x, page.parent[x]}
            if page.tag[u.node] in HEADINGS:
                with_title.add(page.parent[u.node])
    if not credit:
        credit[container(units[0].node)] = 0.0

    def worth(x: int) -> float:
        value, y = credit[x], x
        while y > 0:
            if ASIDE.search(page.sig[y]):
                value *= 0.05
                break
            y = page.parent[y]
        near = x in with_title or page.parent[x] in with_title
        return value * (4 if near else 1)

    main = max(credit, key=worth)
    chain = {main}
    inside: dict[int, list[int]] = {}  # nodes from a unit up to the child of main

    def below(node: int) -> list[int] | None:
        if node not in inside:
            steps, x = [], node
            while x > 0 and x != main:
                steps.append(x)
                x = page.parent[x]
            inside[node] = steps if x == main else None
        return inside[node]

    # shares of the pieces of the body, by the signature of main's child
    parts: dict[str, float] = defaultdict(float)
    total = 0.0
    for u in units:
        steps = below(u.node)
        if steps is not None:
            key = page.sig[steps[-1]] if steps else ""
            size = len(u.text) - (u.linked if u.links > 1 else 0)
            parts[key] += size
            total += size
    bare = max((v for k, v in parts.items() if k in FLOW or not k), default=0.0)
    leaves = max((v for k, v in parts.items() if k and k.split("[")[0] not in FLOW), default=0.0)
    by_leaf = leaves > bare  # paragraphs are plain blocks without an element of their own
    del chain
    out, started = [], False
    first_title = next((i for i, u in enumerate(units) if title and u.text == title and (page.tag[u.node] in HEADINGS or below(u.node) is not None)), None)
    for i, u in enumerate(units):
        keep = False
        if i == first_title:
            keep = started = True
        else:
            steps = below(u.node)
            if steps is not None and (first_title is None or below(units[first_title].node) is None or i > first_title):
                keep = True
                path_links = sums[u.path][3] / sums[u.path][0]
                rest = len(u.text) - u.linked
                heading = any(page.tag[x] in HEADINGS for x in steps)
                if u.links > 1 and rest < 0.45 * len(u.text) and len(PUNCTUATION.findall(u.text)) < 3 + u.links:
                    keep = False  # a row of links
                elif path_links > 0.75 and not heading and sums[u.path][0] > 1 and not SENTENCE_END.search(u.text):
                    keep = False  # a path of links
                elif u.links and rest <= 3 and len(u.text) < 60 and not heading and not SENTENCE_END.search(u.text) and (page.tag[u.node] == "li" or path_links > 0.75):
                    keep = False
                else:
                    for x in steps:
                        tag, sig = page.tag[x], page.sig[x]
                        if tag in FLOW:
                            if tag == "p" and "[" in sig and "p" in parts and parts[sig] < SHARE * total:
                                keep = False
                            elif tag == "p" and "[" in sig and by_leaf and parts[sig] < SHARE * total:
                                keep = False
                        elif x == u.node and by_leaf and tag == "div" and not page.children[x]:
                            pass
                        elif parts.get(page.sig[steps[-1]], 0.0) < SHARE * total or ASIDE.search(sig):
                            keep = False
                        elif tag in ("table", "td", "tr", "form"):
                            keep = False
                        if not keep:
                            break
        out.append((u.text, keep))
    return out


PAGE_UNITS = "id string, hash array<bigint>, keep array<boolean>, md5 array<binary>, bucket array<int>, inside array<bigint>, outside array<bigint>"


def kept(units: list[tuple[str, bool]]) -> list[bytes | None]:
    """The digests of the units in the body, each once; None for all others."""
    out, seen = [], set()
    for text, keep in units:
        found = digest(text) if keep else None
        out.append(None if found in seen else found)
        seen.add(found)
    return out


def page_units(pages: DataFrame) -> DataFrame:
    """One row a page (id, html): masked hash, place and digest of its units; and one a task: in how many pages words stand inside and outside the body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int64)
        kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        names = ["id", "hash", "keep", "md5", "bucket", "inside", "outside"]
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                done = [body(x) for x in part.column(1).to_pylist()]
                for side in (0, 1):
                    found = [x for d in done for x in set().union(*(word_buckets(t) for t, k in d if k == (side == 0)))]
                    seen[side] += np.bincount(np.array(found, np.int64), minlength=BUCKETS)
                n = [None] * len(done)
                columns = [part.column(0), [[hashed(t) for t, _ in d] for d in done], [[k for _, k in d] for d in done], [kept(d) for d in done], n, n, n]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        used = np.flatnonzero(seen.sum(0))
        columns = [[None], [None], [None], [None], [used.tolist()], [seen[0][used].tolist()], [seen[1][used].tolist()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return pages.select("id", "html").mapInArrow(run, PAGE_UNITS)


def lexicon(units: DataFrame) -> DataFrame:
    """``hash`` of the masked texts that are furniture in all pages together."""
    flat = units.where("bucket IS NULL").select(F.explode(F.arrays_zip("hash", "keep")).alias("u")).select("u.*")
    seen = flat.groupBy("hash").agg(F.count("*").alias("n"), F.count_if(~F.col("keep")).alias("outside"))
    n, p, z2 = F.col("n"), F.col("outside") / F.col("n"), Z * Z
    low = (p + z2 / (2 * n) - Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    return seen.where(low > OUTSIDE).select("hash")


def word_odds(units: DataFrame) -> np.ndarray:
    """Log odds of each bucket of words to stand outside a body."""
    rows = (
        units.where("bucket IS NOT NULL").select(F.explode(F.arrays_zip("bucket", "inside", "outside")).alias("u")).select("u.*")
        .groupBy("bucket").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    )  # at most BUCKETS rows
    counts = np.full((2, BUCKETS), PRIOR)
    for r in rows:
        counts[:, r.bucket] += r.inside, r.outside
    return np.log(counts[1] / counts[0]).astype(np.float32)


# Sections.

CRUMB = re.compile(r"^(?!\|)(?:\[ )?[^|>»/·.;!?]{1,40}(?: (?:>|»|\||/|·|›|→) [^|>»/·.;!?]{1,40})+(?: \])?$")
CRUMB_SIGN = re.compile(r" (?:>|»|\||/|·|›|→) ")
SIGNS = re.compile(r"[<>{}*#`$\\~_=\[\]^]|^[|!]|--")


def crumbs(text: str) -> bool:
    """Whether a line is a row of short names with signs between."""
    return CRUMB.match(text) is not None and all(0 < len(x.split()) <= 4 and x.strip(" []")[:1].isupper() for x in CRUMB_SIGN.split(text))


def pseudo_path(line: str) -> tuple[str, int]:
    """The text of a line, and its pseudo-path as a number."""
    plain = " ".join(line.split())
    entry = plain.startswith("- ")
    plain = plain[2:] if entry else plain
    n = len(plain.split())
    return plain, (0 if n <= 5 else 1 if n <= 12 else 2) + 3 * entry + 6 * (SENTENCE_END.search(plain) is not None) + 12 * (SIGNS.search(plain) is not None) + 24 * crumbs(plain)


PATHS = 48


def path_odds(listed: dict[int, int], others: dict[int, dict[int, int]]) -> list[float]:
    """Log odds of noise by pseudo-path, from its lines in the lexicon and a histogram of the word odds of the others.

    The share of noise among the others is what makes itself likely: the fixed point of the mean chance of a line to be
    noise, given the share and its words (expectation maximisation). Without any evidence a line is none.
    """
    out = []
    for path in range(PATHS):
        known, bins = listed.get(path, 0), others.get(path, {})
        n = known + sum(bins.values())
        odds = math.log((known + 1) / (n - known + 2 * PRIOR)) if n else 0.0
        for _ in range(1000):
            mean = known + sum(c / (1 + math.exp(-max(-50.0, min(50.0, odds + (x + 0.5) * BIN)))) for x, c in bins.items())
            after = math.log((mean + 1) / (n - mean + 2 * PRIOR)) if n else 0.0
            odds, before = after, odds
            if abs(odds - before) < 1e-6:
                break
        out.append(odds)
    return out


LINES = "row_key string, row bigint, line int, hash bigint, path int, odds float, md5 binary"


def section_lines(sections: DataFrame, odds: np.ndarray) -> DataFrame:
    """One row a line of sections (id, text) that is not empty: masked hash, pseudo-path, odds of its words, digest."""
    shipped = sections.sparkSession.sparkContext.broadcast(odds)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shipped.value
        memo: dict[str, tuple] = {}
        for batch in batches:
            out = []
            for key, row, text in zip(*(c.to_pylist() for c in batch.columns)):
                for i, line in enumerate(text.split("\n")):
                    found = memo.get(line)
                    if found is None:
                        plain, path = pseudo_path(line)
                        if not plain:
                            continue
                        found = hashed(plain), path, float(weights[list(word_buckets(plain))].sum()), digest(" ".join(line.split()))
                        if len(memo) < 50_000:
                            memo[line] = found
                    out.append((key, row, i, *found))
            columns = zip(*out) if out else [[]] * 7
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["row_key", "row", "line", "hash", "path", "odds", "md5"])

    rows = sections.where(F.col("text").isNotNull() & (F.length("text") > 0) & F.col("id").isNotNull())
    return rows.select("id", F.xxhash64("id", "text").alias("row"), "text").mapInArrow(split, LINES)


def section_noise(sections: DataFrame, words: DataFrame, odds: np.ndarray) -> DataFrame:
    """``row_key, md5`` of the noise lines of sections (id, text); ``words`` are the hashes of the lexicon."""
    known = words.withColumn("listed", F.lit(True))
    lines = checkpoint(section_lines(sections, odds).join(known, "hash", "left").select("row_key", "row", "line", "path", "odds", "md5", F.coalesce("listed", F.lit(False)).alias("listed")))
    known_lines: dict[int, int] = {}
    others: dict[int, dict[int, int]] = {}
    at = F.when(~F.col("listed"), F.floor(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.col("odds"))) / BIN).cast("int"))
    for r in lines.groupBy("path", at.alias("at")).count().collect():  # at most 100 / BIN rows a pseudo-path
        if r["at"] is None:
            known_lines[r["path"]] = r["count"]
        else:
            others.setdefault(r["path"], {})[r["at"]] = r["count"]
    ratio = path_odds(known_lines, others)
    score = F.col("odds") + F.element_at(F.array(*map(F.lit, ratio)), F.col("path") + 1)
    # lines far below the threshold cannot be lifted by their neighbours; lines of the lexicon are noise anyway
    scored = lines.withColumn("score", F.when(F.col("listed"), F.greatest(score, F.lit(1.0))).otherwise(score))
    sure = scored.where("score > 0").select("row_key", "md5")
    near = scored.where(F.col("score") > 0).select("row", F.explode(F.array(F.col("line") - 1, F.col("line") + 1)).alias("line"), (SMOOTH * F.col("score")).alias("lift"))
    lifted = scored.where("score <= 0").join(near.groupBy("row", "line").agg(F.sum("lift").alias("lift")), ["row", "line"])
    return sure.union(lifted.where("score + lift > 0").select("row_key", "md5"))


def found(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """``kind, row_key, unit_md5``: units of the bodies of all pages (id, html), and noise lines of all sections (id, text).

    Null and empty pages and texts, and rows with a null key, give no row; repeated rows count once; of different
    pages with one id each gives its units.
    """
    pages = pages.where(F.col("html").isNotNull() & (F.length("html") > 0) & F.col("id").isNotNull()).select("id", "html")
    units = checkpoint(page_units(distinct_rows(pages)))
    words, n = counted(lexicon(units))
    words = F.broadcast(words) if n * 16 <= BROADCAST_BYTES else words
    flat = units.where("bucket IS NULL").select("id", F.explode(F.arrays_zip("hash", "md5")).alias("u")).where("u.md5 IS NOT NULL").select(F.col("id").alias("row_key"), "u.hash", "u.md5")
    main = flat.join(words, "hash", "left_anti").select(F.lit("page_main").alias("kind"), "row_key", "md5")
    rest = section_noise(sections, words, word_odds(units)).select(F.lit("section_noise").alias("kind"), "row_key", "md5")
    # only pages that share an id can give a unit twice
    several, n = counted(units.where("bucket IS NULL").groupBy(F.col("id").alias("row_key")).count().where("count > 1").select("row_key"))
    several = F.broadcast(several) if n * 100 <= BROADCAST_BYTES else several
    rows = main.join(several, "row_key", "left_anti").union(main.join(several, "row_key", "left_semi").union(rest).distinct()) if n else main.union(rest.distinct())
    return rows.select("kind", "row_key", F.lower(F.hex("md5")).alias("unit_md5"))
