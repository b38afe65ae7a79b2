"""Labelled pages for the markup model: plain blocks of known kind, with the syntax of their kind put around them.

Every line of a generated page carries the label of the construct that it was written for, so the labels come from
the writing, not from looking for syntax. Plain lines also hold the signs that are content in technical texts. Words,
numbers and signs are drawn by rule from a seed; pages of another seed are the held-out set.
"""

from __future__ import annotations

import random
from collections.abc import Callable

TEXT, INLINE, HEADING, LIST, CODE, FORMULA, TABLE, DROP = range(8)

_SCRIPTS = ["abcdefghijklmnoprstuvwyz", "abcdefghijklmnoprstuvwyzäöüßéèñçå", "абвгдежзиклмнопрстуфхцчшщыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "的一是不了人我在有他这中大来上国个到说们"]
_ENDS = [".", ".", ".", ".", ";", "?", ":", "", "!", ")"]


class Writer:
    """Draws words, sentences and blocks."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self, alphabet: str = _SCRIPTS[0]) -> str:
        w = "".join(self.r.choice(alphabet) for _ in range(self.r.randint(1, 10)))
        return w.capitalize() if self.r.random() < 0.15 else w

    def words(self, low: int, high: int) -> list[str]:
        alphabet = _SCRIPTS[0] if self.r.random() < 0.7 else self.r.choice(_SCRIPTS)
        return [str(self.r.randint(1, 2000)) if self.r.random() < 0.1 else self.word(alphabet) for _ in range(self.r.randint(low, high))]

    def phrase(self, low: int = 1, high: int = 4) -> str:
        return " ".join(self.words(low, high))

    def sentence(self, inside: str | None = None) -> str:
        """A sentence, with a piece put in at any place."""
        w = self.words(3, 18)
        if inside is not None:
            w.insert(self.r.randint(0, len(w)), inside)
        return " ".join(w) + self.r.choice(_ENDS)

    def number(self) -> str:
        return self.r.choice([str(self.r.randint(1, 99)), f"{self.r.uniform(0, 90):.2f}"])

    # Signs that are content.
    def content(self) -> str:
        a, b, n, m, w = self.word(), self.word(), self.number(), self.number(), self.word()
        x, y = self.r.choice("abcdxyzT"), self.r.choice("pqrstuv")
        return self.r.choice([
            f"{x} < {n} and {y} > {m}", f"{x}*{y} = {n} * {m}", f"{x} _{{{n}}} {w} ^{{+}}", f"({x} ^{{2}} < {y})", f"[[{n},{m}],[{m},{n}]]", f"{x}[[{n}]]", f"<{n}{n}0> and {{111}}",
            f"|{x}| < |{y}| || {x}", f"'' {w} and ' {a}", f"{a}_{n} of {x}_1", f"{n} ~ {m}", "C[C@H](N)C(=O)O", "CC(=O)Oc1ccccc1C(=O)O", f"C:\\{a}\\{b}{n}", f"{a.upper()}&{b.upper()}",
            f"between ${n} and ${m}", f"grade #{n}", f"{x}<{y} then", f"the <{n} µm part", f"** {a} with {y} < {n}", f"{a} > {b} > {w}", f"{x} = k_{{5}} [{a}]^{{2}}", f"{a} -- not {b} --",
            f"{a} == {b}", f"({n}) [{m}]", f"{a}/{b}", f"“{a}”", f"it's {w}", f"{n} °C", f"[{a} {n}]", f"{{{x}, {y}}}", f"5'-{a.upper()}-3'", f"~{n} %", f"{x} ≤ {n}", f"{a}@{b}.example", f"{n} + {m} - {n}",
            f"!{a} {b}", f"f({x}) = {x}^2", f"${n}", f"{a}+/{b}-", f"#{a}", f"{x}' = -{y}'", f"*{a}", f"{a}* {b}", f"{a} || {b}", f"[{n}, {m})", f"{n}:{m}", f"\"{a}\"", f"{a}__{b}",
        ])

    def plain(self) -> str:
        k = self.r.random()
        if k < 0.45:
            return self.sentence()
        if k < 0.75:
            return self.sentence(self.content())
        if k < 0.85:
            return "- " + (self.phrase(1, 8) if self.r.random() < 0.5 else self.sentence(self.content()))
        if k < 0.95:
            return self.r.choice([self.phrase(), self.content(), ""])
        return self.r.choice([f"* {self.word()} denotes {self.word()} with {self.r.choice('pq')} < {self.number()}, and ** {self.phrase()}.", f"({self.phrase()})", f"“{self.sentence()}”", f"… {self.phrase()}", f"— {self.phrase()}"])

    # Syntax within a line.
    def inline(self) -> str:
        p, w, n = self.phrase(), self.word(), self.number()
        tag = self.r.choice("b i em strong u span font sub sup code tt small big center div p a cite s del kbd q abbr mark".split())
        end = self.r.choice([f"</{tag}>", f"</{tag}>", ""])
        url = self.r.choice([f"https://{w}.example/{n}", f"/wiki/{w}", f"#{w}", f"img/{w}{n}.png", f"mailto:{w}@{w}.example"])
        entity = self.r.choice(["nbsp", "amp", "lt", "gt", "quot", "mdash", "alpha", "#8211", "#x2014", "#160", "eacute", "frac12", "times"])
        command = self.r.choice("emph textbf textit texttt mathrm ce cite ref label footnote alpha beta frac sqrt cdot times approx degree leq SI".split())
        k = [
            f"<{tag}>{p}{end}", f"<{tag} class=\"{w}\">{p}{end}", f"{p}</{tag}>", f"<{tag.upper()} ALIGN=CENTER>{p}", "<br>", "<br/>", f"<img src=\"{w}.png\">", f"<hr>{w}", f"<ref name=\"{w}\"/>", f"<ref>{p}</ref>",
            f"&lt;{tag}&gt;{p}&lt;/{tag}&gt;", f"{w}&{entity};{w}", f"&{entity}; {p}", f"<!-- {p} -->{w}", f"<https://{w}.example/{n}>", f"![{p}]({url})", f"[{p}]({url})", f"[{p}]({url} \"{w}\")", f"[^{n}]", f"{w}[^{w}]",
            f"**{p}**", f"__{p}__", f"~~{p}~~", f"`{p}`", f"[[{w.capitalize()}|{p}]]", f"[[{self.word()} {w}]]", f"{{{{{w}|{p}}}}}", f"{{{{convert|{n.split('.')[0]}|kg}}}}", f"''{p}''", f"'''{p}'''", f"[https://{w}.example {p}]",
            f"\\{command}{{{p}}}", f"\\{command} {w}", f"{n}\\,\\mathrm{{{w}}}", f"{w}~\\cite{{{w}}}", f"$k_{{{n}}}$", f"$x^2 + y = {n}$", "$x$", f"\\({w}_{{2}}\\)", f"\\[{w} = {n}\\]", f"<math>{w} = {n}</math>", f"<nowiki>{p}</nowiki>",
            f"{n}\\;{w}\\,\\%", f"{{\\displaystyle {w}_{{2}}}}", f"\\{self.r.choice(['alpha', 'beta', 'gamma'])}-form",
        ]
        return self.r.choice(k)

    def marked(self) -> str:
        s = self.sentence(self.inline())
        while self.r.random() < 0.3:
            s += " " + self.sentence(self.inline() if self.r.random() < 0.5 else self.content())
        return self.r.choice(["", "", "", "- "]) + s

    def any(self) -> str:
        return self.marked() if self.r.random() < 0.25 else self.plain() or self.word()

    # Blocks of lines, each with its label.
    def block(self) -> list[tuple[str, int]]:
        p, w, n = self.phrase(), self.word(), self.number()
        rows = lambda make, low=1, high=4: [make() for _ in range(self.r.randint(low, high))]
        kind = self.r.choice("text text text text inline inline inline head head list list code code formula table table drop drop quote".split())
        if kind == "text":
            return [(x, TEXT) for x in rows(self.plain)]
        if kind == "inline":
            return [(x, INLINE) for x in rows(self.marked, 1, 2)]
        if kind == "quote":
            return [(f"> {self.any()}", INLINE) for _ in range(self.r.randint(1, 2))]
        if kind == "head":
            level = self.r.randint(1, 5)
            eq = "=" * (level + 1)
            extra = self.inline() if self.r.random() < 0.15 else ""
            return [(self.r.choice([f"{'#' * level} {p} {extra}", f"{eq} {p} {extra}{eq}", f"{eq}{p}{eq}", f"<h{level}>{p}{extra}</h{level}>", f"<H{level} ALIGN=CENTER>{p}", f"\\section{{{p}}}", f"\\subsection*{{{p}}} {extra}", f"\\paragraph{{{p}}}"]).strip(), HEADING)]
        if kind == "list":
            k = self.r.randint(0, 5)
            if k == 5:
                return [(f"{self.r.choice(['<li>', '<li>', '<dt>', '<dd>', '</li><li>', '<LI>'])}{self.any()}{self.r.choice(['</li>', '', '</ul>'])}", LIST) for _ in range(self.r.randint(1, 2))]
            if k == 0:
                return [(f"{self.r.choice(['*', '*', '+'])} {self.any()}", LIST) for _ in range(self.r.randint(2, 4))]
            if k == 1:
                return [(f"* [{self.r.choice([' ', 'x'])}] {self.any()}", LIST) for _ in range(self.r.randint(1, 3))]
            if k == 2:
                return [("\\begin{itemize}", LIST), *[(f"\\item {self.any()}", LIST) for _ in range(self.r.randint(1, 3))], ("\\end{itemize}", LIST)]
            if k == 3:
                return [("<ul>" + "".join(f"<li>{self.phrase()}</li>" for _ in range(self.r.randint(1, 3))) + "</ul>", LIST)]
            return [("<ul>", LIST), *[(f"<li>{self.any()}{self.r.choice(['</li>', ''])}", LIST) for _ in range(self.r.randint(1, 3))], ("</ul>", LIST)]
        if kind == "code":
            body = rows(lambda: self.r.choice([f"{w} = {n} * {self.word()}", f"if {w} < {n}:", f"    return {w}[{n}]", f"# {p}", self.any(), f"for ({w}; {w} < {n}; {w}++) {{", "}", f"<b>{w}</b>", f"| {w} | {n} |", f"== {p} ==", "-----------", f"print('{p}')"]), 1, 5)
            start, end = self.r.choice([("```", "```"), (f"```{w}", "```"), ("~~~", "~~~"), ("<pre>", "</pre>"), (f"<syntaxhighlight lang=\"{w}\">", "</syntaxhighlight>"), ("\\begin{verbatim}", "\\end{verbatim}")])
            if self.r.random() < 0.15 and start == "<pre>":
                return [(f"<pre>{p}</pre>", CODE)]
            return [(x, CODE) for x in [start, *body, end]]
        if kind == "formula":
            body = rows(lambda: self.r.choice([f"r = k_{{{n}}}", f"x^2 + {w} = {n}", f"\\frac{{{n}}}{{x}}", f"{w} &= {n}", f"\\alpha + {n} = \\beta"]), 1, 2)
            env = self.r.choice(["equation", "align", "gather", "equation*"])
            start, end = self.r.choice([(f"\\begin{{{env}}}", f"\\end{{{env}}}"), ("\\[", "\\]"), ("$$", "$$")])
            return [(x, FORMULA) for x in [start, *body, end]]
        if kind == "table":
            cells = lambda join: join.join(self.phrase(1, 2) for _ in range(self.r.randint(2, 4)))
            k = self.r.randint(0, 5)
            if k == 4:
                out = [f"<table>{''.join(f'<tr><td>{self.phrase()}</td><td>{self.phrase()}</td></tr>' for _ in range(self.r.randint(1, 2)))}</table>"]
            elif k == 5:
                out = [self.r.choice([f"<tr><td>{p}</td><td>{w}</td></tr>", f"<tr><td>{p}<td>{w}", f"<td>{p}</td>", f"{p}</td><td>{w}</td></tr>", "</table>", "</td></tr>", "</tr></table>"])]
            elif k == 0:
                out = [self.r.choice(['{| class="wikitable"', "{|"]), f"! {cells(' !! ')}", *sum(([self.r.choice(["|-", "|-"]), f"| {cells(' || ')}"] for _ in range(self.r.randint(1, 3))), []), "|}"]
            elif k == 1:
                out = [f"| {cells(' | ')} |", self.r.choice(["|---|---|", "|---|:--:|", "| --- | --- |", "|:--|--:|"]), *[f"| {cells(' | ')} |" for _ in range(self.r.randint(1, 3))]]
            elif k == 2:
                out = [self.r.choice(["<table>", '<table border="1">']), *[f"<tr><td>{self.phrase()}</td><td>{self.phrase()}{self.r.choice(['</td></tr>', ''])}" for _ in range(self.r.randint(1, 3))], "</table>"]
            else:
                out = ["\\begin{tabular}{ll}", *[f"{self.phrase()} & {self.phrase()} \\\\" for _ in range(self.r.randint(1, 3))], "\\end{tabular}"]
            return [(x, TABLE) for x in out]
        k = self.r.randint(0, 4)
        if k == 0:
            return [("{{" + f"Infobox {w}", DROP), *[(f"| {self.word()} = {self.phrase()}{self.r.choice(['', '', ' ' + self.inline()])}", DROP) for _ in range(self.r.randint(1, 4))], ("}}", DROP)]
        if k == 1:
            return [(self.r.choice([f"[[Category:{p}]]", f"[[File:{p}.png|thumb|left|{self.phrase()}]]", f"[[Image:{w}.jpg|{n}px]]"]), DROP)]
        if k == 2:
            return [(self.r.choice(["__NOTOC__", "__TOC__", "__NOEDITSECTION__"]), DROP)]
        if k == 3:
            return [(self.r.choice(["-----------", "----", "====", "***", "_____"]), DROP)]
        return [(f"<!-- {p} -->", DROP)] if self.r.random() < 0.5 else [(f"<!-- {p}", DROP), *[(self.phrase(), DROP) for _ in range(self.r.randint(0, 2))], (f"{p} -->", DROP)]

    def page(self) -> tuple[list[str], list[int]]:
        """Lines and labels of a page; in a noisy one, other syntax lies around whole lines or within them."""
        out = [x for _ in range(self.r.randint(1, 6)) for x in self.block()]
        if self.r.random() < 0.2:
            i = self.r.randrange(len(out))
            line, label = out[i]
            if label not in (CODE, TEXT) and line.strip():
                tag = self.r.choice("b i em span".split())
                out[i] = self.r.choice([f"<{tag}>{line}</{tag}>", f"{line} {self.inline()}", f"**{line}**" if "*" not in line else line]), label
        if out and self.r.random() < 0.1:
            out.insert(self.r.randrange(len(out) + 1), ("", TEXT)) if all(x != CODE for _, x in out) else None
        return [x for x, _ in out], [y for _, y in out]


def pages(n: int, seed: int) -> list[tuple[list[str], list[int]]]:
    """``n`` labelled pages; the same ones for the same seed."""
    writer: Callable = Writer(seed).page
    return [writer() for _ in range(n)]
