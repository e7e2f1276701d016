"""Markup residue of HTML, Markdown, wiki and LaTeX in texts: wrappers per host, kinds found, clean text."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataseek.operators.dedup import one_per_key
from strataseek.operators.skew import join_facts
from strataseek.runtime import materialise

LANGUAGES = ("html", "markdown", "wiki", "latex")

# Element names of HTML.
_TAGS = (
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed "
    "fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noframes noscript object ol optgroup "
    "option output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
)
_TAG = "(?i:" + "|".join(sorted(_TAGS.split(), key=len, reverse=True)) + ")"
_BLOCK_TAGS = set("address article aside blockquote body br center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())

#: Constructs in the order in which they are tried at a position; the name before ``__`` is the language.
_CONSTRUCTS = {
    # code first: what stands inside is nobody else's markup
    "markdown__fence": r"^[ \t]{0,3}(?P<f>`{3,}|~{3,})(?P<info>[^\n`]*)\n(?P<fbody>[\s\S]*?)(?:^[ \t]{0,3}(?P=f)[`~]*[ \t]*$|\Z)",
    "latex__verbatim": r"\\begin\{(?P<ve>verbatim\*?|Verbatim|lstlisting|minted)\}(?:\[[^\]\n]*\])?(?:\{\w+\})?\n?(?P<vbody>[\s\S]*?)(?:\\end\{(?P=ve)\}|\Z)",
    "html__pre": r"<pre\b[^<>]*>(?P<pbody>[\s\S]*?)(?:</pre\s*>|\Z)",
    "wiki__source": r"<(?P<ws>syntaxhighlight|source|nowiki)\b[^<>]*>(?P<wbody>[\s\S]*?)(?:</(?P=ws)\s*>|\Z)",
    "html__code": r"<(?P<hc>code|tt|kbd|samp)\b[^<>]*>(?P<hbody>[\s\S]*?)</(?P=hc)\s*>",
    "html__script": r"<(?P<hs>script|style)\b[^<>]*>[\s\S]*?(?:</(?P=hs)\s*>|\Z)",
    "html__comment": r"<!--[\s\S]*?(?:-->|\Z)|<!DOCTYPE[^>]*>|<\?xml[^>]*>|-->",
    "markdown__code": r"(?P<t>`{1,2})(?!`)(?P<cbody>[^\n`]+?(?:`[^\n`]+?)*?)(?P=t)(?!`)",
    "latex__display": r"\$\$[^$]+?\$\$|\\\[[\s\S]*?(?:\\\]|\Z)|\\\([^\n]*?\\\)|\\begin\{(?P<de>(?:equation|align|gather|multline|eqnarray|displaymath|math)\*?)\}[\s\S]*?(?:\\end\{(?P=de)\}|\Z)",
    "latex__math": r"(?<![\w$\\])\$(?=[^$\n]*[\\^_{=+<>*/-]|[A-Za-z]\$)(?![\s$])[^$\n]{0,400}?(?<![\s\\])\$(?![\w$])",
    "latex__env": r"\\(?:begin|end)\{(?P<env>[A-Za-z]+\*?)\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?",
    "latex__heading": r"\\(?P<lh>part|chapter|section|subsection|subsubsection|paragraph|title)\*?\{(?P<lht>[^{}\n]*)\}?",
    "latex__item": r"^[ \t]*\\item\b(?:\[(?P<it>[^\]\n]*)\])?[ \t]*",
    "latex__command": r"(?<![\w:\\])~?\\(?P<lc>[A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{(?P<lct>[^{}\n]*)\}|(?<![\w:\\])\\(?:maketitle|newpage|clearpage|noindent|hline|LaTeX|TeX|ldots|dots|par|centering|tableofcontents|appendix|newline|linebreak|smallskip|medskip|bigskip|toprule|midrule|bottomrule|textbackslash|alpha|beta|gamma|delta|lambda|sigma|leq|geq|times|cdot|infty)\b|\\\\(?=[ \t]*$)",
    "html__tag": r"<(?P<close>/?)(?P<tag>" + _TAG + r")(?![\w-])(?P<attr>[^<>]*)/?>|<(?P<bclose>/?)(?P<btag>" + _TAG + r")(?:[ \t]+[a-zA-Z-]+=[\"'][^\"'\n]*[\"']?|(?=[ \t]*$))",
    "html__entity": r"&(?:[A-Za-z]{2,12}[0-9]{0,2}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});",
    "wiki__heading": r"^(?P<wh>={2,6})[ \t]*(?P<wht>[^=\n][^\n]*?)[ \t]*={2,6}[ \t]*$",
    "wiki__table": r"^[ \t]*\{\|[^\n]*|^[ \t]*\|\}|^[ \t]*\|-+[ \t]*(?:\w+=[^\n]*)?$|^[ \t]*![^\n!\[]*(?:!![^\n]*)?$(?=\n[ \t]*(?:\||!))|^[ \t]*\|\+[^\n]*",
    "wiki__row": r"^[ \t]*\|(?![-+}|])(?P<wr>[^\n|]*(?:\|\|[^\n|]*)+)$",
    "wiki__link": r"\[\[(?:(?P<wns>Category|File|Image|Media|Template|Special|Kategorie|Datei|Catégorie|Fichier|Categoría|Archivo|分类|文件):)?(?P<wlt>[^\[\]\n|]*)(?:\|(?P<wll>[^\[\]\n]*))?\]\]",
    "wiki__template": r"\{\{[^{}]*(?:\{\{[^{}]*\}\}[^{}]*)*\}\}|\{\{(?=[A-Za-z])|(?<!\})\}\}(?!\})",
    "wiki__quote": r"'{2,5}",
    "wiki__tag": r"</?(?:ref|references|gallery|includeonly|noinclude|onlyinclude|math)\b[^<>]*>|__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION|INDEX|NOINDEX)__|^#(?:REDIRECT|WEITERLEITUNG|REDIRECTION)\b",
    "wiki__nested": r"^(?:\*{2,}|[*#:;]*\*[#:;*]+|[;:]{2,})[ \t]*(?=\S)(?![^\n]*\*\*)",
    "markdown__heading": r"^[ \t]{0,3}(?P<mh>#{1,6})[ \t]+(?P<mht>[^\n]+?)[ \t]*#*[ \t]*$",
    "markdown__setext": r"^(?P<sh>(?![ \t]*[-*+>|#])[^\n]*\S[^\n]*)\n(?P<sb>={3,}|-{3,})[ \t]*$",
    "markdown__underline": r"^={3,}[ \t]*$",
    "markdown__rule": r"^[ \t]{0,3}(?:\*[ \t]*){3,}$|^[ \t]{0,3}(?:_[ \t]*){3,}$",
    "markdown__footdef": r"^[ \t]{0,3}\[\^[^\]\s]+\]:[ \t]*",
    "markdown__refdef": r"^[ \t]{0,3}\[[^\]^\n]+\]:[ \t]+\S+[^\n]*$",
    "markdown__footnote": r"\[\^[^\]\s]+\]",
    "markdown__image": r"!\[(?P<ia>[^\]\n]*)\](?:\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)?|\[[^\]\n]*\])",
    "markdown__link": r"(?<!\])\[(?P<la>[^\[\]\n]+)\](?:\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)|\((?=(?:https?:|/|\.|#|\w+\.\w)[^\s)]*[ \t]*$)[^\s)]*|\[[^\]\n]*\])",
    "markdown__auto": r"<(?:https?://|mailto:)[^<>\s]+>",
    "markdown__tablesep": r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*$",
    "markdown__row": r"^[ \t]*\|(?![|}+-])(?P<mr>[^\n]*[^|\n])\|[ \t]*$",
    "markdown__quote": r"^[ \t]{0,3}(?:>[ \t]?)+(?=\S|$)",
    "markdown__task": r"^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]+",
    "markdown__strong": r"(?<![\w*])\*{2,3}(?=[^\s*])|(?<=[^\s*])\*{2,3}(?![\w*])|(?<![\w_])__(?=[^\s_])|(?<=[^\s_])__(?![\w_])",
    "markdown__em": r"(?<![\w*\\])\*(?P<em>[^\s*][^*\n]*?(?<![\s*]))\*(?![\w*])|(?<![\w_\\/.])_(?P<em2>[^\s_][^_\n]*?(?<![\s_]))_(?![\w_/])",
    "markdown__strike": r"~~(?=\S)[^~\n]*(?<=\S)~~",
    "text__bullet": r"^[ \t]*(?:[-*+•][ \t]+|\d{1,4}[.)][ \t]+)(?=\S)",
}
#: Constructs by the first character that is not blank; a line above a row of = or - may start with any.
_FIRST = {
    "`": "fence code",
    "~": "fence command strike",
    "\\": "verbatim display env heading item command",
    "<": "pre source code script comment tag auto",
    "$": "display math",
    "&": "entity",
    "=": "heading underline",
    "{": "table template",
    "}": "template",
    "|": "table row tablesep",
    "!": "table image",
    "[": "link footdef refdef footnote",
    "'": "quote",
    "_": "tag rule strong em",
    "#": "tag nested heading",
    "*": "nested rule task strong em bullet",
    ":": "nested tablesep",
    ";": "nested",
    ">": "quote",
    "-": "comment tablesep task bullet",
    "+": "task bullet",
    "•": "bullet",
    **{d: "bullet" for d in "0123456789"},
}


def _compiled(names: list[str]) -> re.Pattern[str]:
    return re.compile("|".join(f"(?P<{n}>{_CONSTRUCTS[n]})" for n in names), re.M)


_SCANNERS = {c: _compiled([n for n in _CONSTRUCTS if n.partition("__")[2] in kinds.split()]) for c, kinds in _FIRST.items()}
_SETEXT = _compiled(["markdown__setext"])
_START = re.compile(r"^[ \t]*(?=[`~>|!{#=*+•:;_<\[\\-]|\d{1,4}[.)])|(?=[`<\\$&\[{}*_~']|!\[|-->)", re.M)
_BAR = re.compile(r"^(?:={3,}|-{3,})[ \t]*$", re.M)
_LINE = re.compile(r"[^\n]*")


def _constructs(text: str) -> Iterator[tuple[str, re.Match[str]]]:
    """Constructs of a text from left to right, disjoint."""
    above = iter([text.rfind("\n", 0, m.start() - 1) + 1 for m in _BAR.finditer(text) if m.start()])
    line = next(above, None)
    pos, n = 0, len(text)
    while pos < n:
        trigger = _START.search(text, pos)
        while line is not None and line < pos:
            line = next(above, None)
        at = trigger.start() if trigger else n
        if line is not None and line <= at:
            m = _SETEXT.match(text, line)
            if m:
                yield "markdown__setext", m
                pos = m.end()
                continue
            line = next(above, None)
            continue
        if not trigger:
            return
        scanner = _SCANNERS.get(text[trigger.end()])
        m = scanner.match(text, at) if scanner else None
        if not m and trigger.end() > at:  # blanks belong to some constructs only
            at = trigger.end()
            m = scanner.match(text, at) if scanner else None
        if m and m.end() > m.start():
            yield m.lastgroup if m.lastgroup in _CONSTRUCTS else next(k for k in m.re.groupindex if k in _CONSTRUCTS and m.group(k) is not None), m
            pos = m.end()
        else:
            pos = at + 1


_PROSE = r"(?i)\.(?:md|mdx|txt|rst|tex|html)$"
_LEVEL = {"title": 1, "part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}


def tokens(text: str) -> Iterator[tuple[str, re.Match[str] | str]]:
    """Symbols of a text in order: constructs with their match, ``T`` with the text between. Line ends must be LF."""
    at = 0
    for name, m in _constructs(text):
        if m.start() > at and not text[at : m.start()].isspace():
            yield "T", text[at : m.start()]
        elif m.start() > at:
            yield "", text[at : m.start()]
        if name == "html__tag":
            name = f"html__{m['close'] or m['bclose'] or ''}{(m['tag'] or m['btag']).lower()}"
        elif name == "latex__env":
            name = f"latex__{m['env']}"
        yield name, m
        at = m.end()
    if at < len(text):
        yield ("T" if not text[at:].isspace() else ""), text[at:]


# Elements without content.
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_ENVIRONMENTS = set("itemize enumerate description document abstract figure table tabular center quote quotation theorem proof lemma definition".split())
_PARTNERS = {"markdown__strong", "wiki__quote"}
#: Symbols whose tokens, where not whole, are lone symbols, as plain text has them too: half of a pair of marks, an end of a
#: template or comment without its beginning, a mark at the start of a line that is no block.
LONE = _PARTNERS | {"wiki__template", "html__comment", "markdown__quote", "markdown__rule", "markdown__underline", "wiki__nested"}


def _is_block(s: str, m: re.Match[str], text: str) -> bool:
    """Whether a mark at the start of a line stands where its block does: a quote begins a paragraph or has several lines, a rule is a paragraph, a nested item follows an item of its list."""
    start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end()) + 1
    above = text[text.rfind("\n", 0, start - 1) + 1 : start - 1].strip() if start else ""
    below = (_LINE.match(text, end)[0] if end else "").strip()
    if s == "wiki__nested":
        return above[:1] == m.group(0)[0]
    return not above or above[0] == ">" or below[:1] == ">" if s == "markdown__quote" else not above and not below


def _wholes(found: list[tuple[str, re.Match[str] | str]], text: str) -> list[bool]:
    """For each token whether its construct is whole: closed where it opens, or unmistakable by itself."""
    whole = [True] * len(found)
    names = {s for s, _ in found}
    several = "\n" in text.strip()  # one line by itself does not show that it is a block
    has_table = any(s == "wiki__table" and m.group(0).lstrip().startswith("{|") for s, m in found)
    opened: dict[str, list[int]] = {}
    marks: dict[str, int] = {}  # open ones of a paragraph
    missing: dict[int, int] = {}  # partners that a mark still lacks
    for i, (s, m) in enumerate(found):
        if s in ("T", ""):
            if "\n\n" in m:
                marks.clear()
            continue
        g, kind = m.group(0), s.partition("__")[2]
        if s in _PARTNERS:  # marks come in pairs within a paragraph
            for mark in ("''", "'''") if len(g) == 5 else ("'''",) if g[0] == "'" and len(g) > 2 else (g[:2],):
                other = marks.pop(mark, None)
                if other is None:
                    marks[mark] = i
                    missing[i] = missing.get(i, 0) + 1
                else:
                    missing[other] -= 1
                    whole[other] = not missing[other]
            whole[i] = not missing.get(i)
        elif s == "markdown__underline":  # the title above is missing
            whole[i] = False
        elif s in ("markdown__quote", "markdown__rule", "wiki__nested"):
            whole[i] = (several or s == "wiki__nested") and _is_block(s, m, text)
        elif s in ("markdown__fence", "latex__verbatim", "html__pre", "wiki__source"):
            whole[i] = m.end() > m.end({"markdown__fence": "fbody", "latex__verbatim": "vbody", "html__pre": "pbody", "wiki__source": "wbody"}[s])
        elif s == "latex__display":
            whole[i] = g.endswith(("$$", "\\]", "\\)")) or "\\end{" in g
        elif s == "html__script":
            whole[i] = g.endswith(">") and "</" in g
        elif s == "html__comment":
            whole[i] = g.startswith("<")
        elif s == "wiki__template":
            if g == "{{":
                opened.setdefault(s, []).append(i)
            elif g == "}}":
                whole[i] = bool(opened.get(s)) and opened[s].pop() >= 0
        elif s in ("markdown__image", "markdown__link"):
            whole[i] = g.endswith((")", "]"))
        elif s == "latex__heading":
            whole[i] = g.endswith("}")
        elif s in ("wiki__table", "wiki__row"):
            whole[i] = has_table
        elif s == "markdown__row":
            whole[i] = "markdown__tablesep" in names
        elif s == "markdown__tablesep":
            whole[i] = "markdown__row" in names
        elif s.startswith("html__") and "tag" in m.re.groupindex and (m["tag"] or m["btag"]):
            if m["btag"]:
                whole[i] = False
            elif kind not in _VOID:
                tag = kind.lstrip("/")
                if kind[0] != "/":
                    whole[i] = False
                    opened.setdefault(s, []).append(i)
                elif opened.get(f"html__{tag}"):
                    whole[opened[f"html__{tag}"].pop()] = True
                else:
                    whole[i] = False
        elif s.startswith("latex__") and "env" in m.re.groupindex and m["env"]:
            if g.startswith("\\begin"):
                whole[i] = False
                opened.setdefault(s, []).append(i)
            elif opened.get(s):
                whole[opened[s].pop()] = True
            else:
                whole[i] = False
    return whole


def stream(text: str) -> list[list[tuple[int, str, int]]]:
    """The token stream of a text in blocks, one for each line with markup: (number of the token, symbol, weight).

    ``T`` stands for a stretch of text, with number -1 and weight 0. A whole
    construct weighs 2; a broken one (half of a pair, or without its end) and
    a lone symbol (LONE) weigh 1. Line ends must be LF.
    """
    found = list(tokens(text))
    whole = _wholes(found, text)
    blocks: list[list[tuple[int, str, int]]] = []
    block: list[tuple[int, str, int]] = []

    def end() -> None:
        nonlocal block
        if any(n >= 0 for n, _, _ in block):
            blocks.append(block)
        block = []

    for i, (s, m) in enumerate(found):
        if s in ("T", ""):
            first, *others = m.split("\n")
            for part in (first, *others[-1:]):
                if part is not first or others and part is others[-1]:
                    end()
                if part and not part.isspace() and (not block or block[-1][1] != "T"):
                    block.append((-1, "T", 0))
        else:
            symbol = "latex__env" if s.startswith("latex__") and s not in _CONSTRUCTS and s[7:].rstrip("*") not in _ENVIRONMENTS else s
            block.append((i, symbol, 2 if whole[i] else 1))
            if m.group(0).endswith("\n"):
                end()
    end()
    return blocks


def signature(text: str) -> str:
    """The token stream of a text as one line: symbols and ``T`` for each stretch of text."""
    return " ".join(s for block in stream(re.sub(r"\r\n?", "\n", text)) for _, s, _ in block)


# A wrapper is a union-free expression, nested twice: a text is a repeated group of optional lines, told apart by their
# first symbol; the expression of a line is a list of items [symbols, least, most, weights], with least 0 or 1 and most 1
# or 0 for any number. Weights say how much the streams aligned at an item vouch for each of its symbols: 2 for a whole
# construct, 1 for a broken one. A lone symbol has items of its own, its name with "?", and weighs 1 in a text that has
# constructs of its language, else -1. A line that grows beyond MAX_ITEMS becomes one repeated group of optional symbols,
# [["*", symbols...], 0, 0, weights].
MAX_ITEMS = 48
_LONGEST_GROUP = 4
#: Weight from which a symbol is a template token: whole once, or broken in two places. Below it is part of a text slot.
TEMPLATE_MIN = 2
#: The same for a lone symbol: most of those there stand in texts with other constructs of the language. No mere number of
#: lone symbols will do, else a large table would vouch for all of them.
LONE_MIN = 1


def is_template(symbol: str, own: int, weight: int) -> bool:
    """Whether a token of weight ``own`` is a template token at an item of that weight; whole constructs are."""
    return own == 2 or weight >= (LONE_MIN if symbol.endswith("?") else TEMPLATE_MIN)


def for_wrapper(blocks: list[list[tuple[int, str, int]]]) -> list[tuple[list[str], list[int]]]:
    """Symbols and weights of the lines of a stream as they go into the wrapper."""
    lone = [[w == 1 and s in LONE for _, s, w in block] for block in blocks]
    spoken = {s.partition("__")[0] for block, x in zip(blocks, lone, strict=True) for (_, s, _), is_lone in zip(block, x, strict=True) if not is_lone}
    return [
        (
            [s + "?" if is_lone else s for (_, s, _), is_lone in zip(block, x, strict=True)],
            [(1 if s.partition("__")[0] in spoken else -1) if is_lone else w for (_, s, w), is_lone in zip(block, x, strict=True)],
        )
        for block, x in zip(blocks, lone, strict=True)
    ]


def fold(symbols: list[str], weights: list[int]) -> list[list]:
    """The expression of one line: neighbouring repeats of a group become one repeated group."""
    out: list[list] = []
    i, n = 0, len(symbols)
    while i < n:
        for g in range(min(_LONGEST_GROUP, (n - i) // 2), 0, -1):
            k = 1
            while symbols[i + k * g : i + (k + 1) * g] == symbols[i : i + g]:
                k += 1
            if k > 1:
                break
        else:
            g, k = 1, 1
        out.append([symbols[i : i + g], 1, 0 if k > 1 else 1, [sum(weights[i + x : i + k * g : g]) for x in range(g)]])
        i += g * k
    return close(out) if len(out) > MAX_ITEMS else out


def close(items: list[list]) -> list[list]:
    """The most general expression over the symbols of ``items``: a repeated group in which each is optional."""
    sums: dict[str, int] = {}
    for group, _, _, weights in items:
        for s, w in zip(group[1:] if group[0] == "*" else group, weights, strict=True):
            sums[s] = sums.get(s, 0) + w
    names = sorted(sums)
    return [[["*", *names], 0, 0, [sums[s] for s in names]]]


def is_closed(items: list[list]) -> bool:
    return len(items) == 1 and items[0][0][:1] == ["*"]


def _common(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """Pairs of equal groups of two expressions in a longest common subsequence."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, ga = best[i], best[i + 1], a[i][0]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if ga == b[j][0] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i][0] == b[j][0]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[list], b: list[list]) -> list[list]:
    """The expression of both: aligned groups merge their numbers and weights, mismatches become optional."""
    if is_closed(a) or is_closed(b):
        return close(a + b)
    out: list[list] = []
    i = j = 0
    for x, y in [*_common(a, b), (len(a), len(b))]:
        out += [[g, 0, most, w] for g, _, most, w in a[i:x]] + [[g, 0, most, w] for g, _, most, w in b[j:y]]
        if x < len(a):
            out.append([a[x][0], min(a[x][1], b[y][1]), min(a[x][2], b[y][2]), [p + q for p, q in zip(a[x][3], b[y][3], strict=True)]])
        i, j = x + 1, y + 1
    return close(out) if len(out) > MAX_ITEMS else out


def vouch(items: list[list], line: list[list], n: int) -> None:
    """Adds the weights of ``n`` streams with a folded line to the items of the expression at which ``settle`` finds its symbols."""
    if is_closed(items):
        at = {s: x for x, s in enumerate(items[0][0][1:])}
        for group, _, _, weights in line:
            for s, w in zip(group[1:] if group[0] == "*" else group, weights, strict=True):
                items[0][3][at[s]] += w * n
        return
    pairs = _common(line, items)
    if len(pairs) < len(line):
        raise ValueError("the wrapper was not made from this line")
    for x, y in pairs:
        items[y][3] = [p + q * n for p, q in zip(items[y][3], line[x][3], strict=True)]


def settle(items: list[list], symbols: list[str]) -> list[int] | None:
    """The weight of each symbol of a line at the item where the expression matches it; None if it does not match."""
    if is_closed(items):
        known = dict(zip(items[0][0][1:], items[0][3], strict=True))
        return [known[s] for s in symbols] if set(symbols) <= known.keys() else None
    mine = fold(symbols, [0] * len(symbols))
    pairs = _common(mine, items)
    if len(pairs) < len(mine):
        return None
    out: list[int] = []
    for (group, _, most, _), (_, y) in zip(mine, pairs, strict=True):
        k = 1
        at = len(out)
        while most == 0 and symbols[at + k * len(group) : at + (k + 1) * len(group)] == group:
            k += 1
        out += items[y][3] * k
    return out


#: Parts into which the lines of a host are divided; each gives a wrapper, and these are aligned in order. A fixed number,
#: so that wrappers do not depend on the cluster.
PARTS = 32
#: A host of fewer streams than this is judged by the wrapper of all hosts.
HOST_MIN = 200
ALL_HOSTS = "\0"
_WRAPPERS = "host string, lead string, part int, items string"


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Aligns the expressions of each (host, lead, part), whose rows stand together in a fixed order."""
    key, items = None, []
    out: list[tuple] = []
    for pdf in batches:
        for *k, text in zip(pdf["host"], pdf["lead"], pdf["part"], pdf["items"], strict=True):
            mine = json.loads(text)
            if k == key:
                items = align(items, mine)
            else:
                if key:
                    out.append((*key, json.dumps(items)))
                key, items = k, mine
        yield pd.DataFrame(out, columns=["host", "lead", "part", "items"])
        out = []
    yield pd.DataFrame([(*key, json.dumps(items))] if key else [], columns=["host", "lead", "part", "items"])


def _aligned(rows: DataFrame) -> DataFrame:
    """One row per (host, lead, part): the alignment of its rows, in order of ``order``."""
    keys = ["host", "lead", "part"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "order").select(*keys, "items").mapInPandas(_merge, _WRAPPERS)


def _vouched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The wrapper of each (host, lead, part) with the weights of its lines; rows stand together, the wrapper (n = 0) first."""
    key, items = None, []
    for pdf in batches:
        out: list[tuple] = []
        for *k, n, text in zip(pdf["host"], pdf["lead"], pdf["part"], pdf["n"], pdf["items"], strict=True):
            mine = json.loads(text)
            if n:
                vouch(items, mine, n)
                continue
            if key:
                out.append((*key, json.dumps(items)))
            key, items = k, [[g, least, most, [0] * len(w)] for g, least, most, w in mine]
        yield pd.DataFrame(out, columns=["host", "lead", "part", "items"])
    yield pd.DataFrame([(*key, json.dumps(items))] if key else [], columns=["host", "lead", "part", "items"])


def wrappers(lines: DataFrame) -> DataFrame:
    """The wrapper of each host and of all hosts (ALL_HOSTS): host, lead, items (JSON).

    ``lines``: host, lead, items (the folded line), n (streams of the host
    with that line); read several times. The lines of a host are divided by
    their hash into PARTS streams, each aligned in sorted order in bounded
    memory; the PARTS wrappers of a host are then aligned in order, and those
    of all hosts in the same two steps. The weights are those of all lines at
    the items they match in the finished wrapper, where an alignment may have
    had several equal choices on the way.
    """
    part = F.pmod(F.xxhash64("items"), F.lit(PARTS)).cast("int").alias("part")
    one = lambda df, order: _aligned(df.select("host", "lead", F.lit(0).alias("part"), order.alias("order"), "items"))
    hosts = materialise(one(_aligned(lines.select("host", "lead", part, F.col("items").alias("order"), "items")), F.col("part")).drop("part"))
    spread = hosts.select(F.lit(ALL_HOSTS).alias("host"), "lead", F.pmod(F.xxhash64("host"), F.lit(PARTS)).cast("int").alias("part"), F.col("host").alias("order"), "items")
    made = hosts.unionByName(one(_aligned(spread), F.col("part")).drop("part"))
    every = lines.groupBy("lead", "items").agg(F.sum("n").alias("n")).select(F.lit(ALL_HOSTS).alias("host"), "lead", part, "n", "items")
    every = lines.select("host", "lead", part, "n", "items").unionByName(every)
    copies = every.select("host", "lead", "part").distinct().join(made, ["host", "lead"]).select("host", "lead", "part", F.lit(0).cast("long").alias("n"), "items")
    keys = ["host", "lead", "part"]
    weighed = every.unionByName(copies).repartition(*keys).sortWithinPartitions(*keys, "n", "items").mapInPandas(_vouched, _WRAPPERS)
    return one(weighed, F.col("part")).drop("part")


#: Wrappers are broadcast up to this number of hosts (a wrapper has some ten kB); beyond it only those of hot hosts are.
HOSTS_MAX = 2_000


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["sig"] = [json.dumps(x) if (x := stream(re.sub(r"\r\n?", "\n", t))) else "" for t in pdf["content"]]
        yield pdf[["chunk_id", "host", "sig"]]


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(host, symbols[0], json.dumps(fold(symbols, weights))) for host, sig in zip(pdf["host"], pdf["sig"], strict=True) for symbols, weights in for_wrapper(json.loads(sig))]
        yield pd.DataFrame(rows, columns=["host", "lead", "items"])


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, dict[str, list]] = {}
    for pdf in batches:
        rows = []
        for key, sig, wrapper in zip(pdf["chunk_id"], pdf["sig"], pdf["wrapper"], strict=True):
            if wrapper not in known:
                if len(known) > 1000:
                    known.clear()
                known[wrapper] = {lead: json.loads(items) for lead, items in json.loads(wrapper).items()}
            kinds: set[str] = set()
            slots: list[int] = []
            blocks = json.loads(sig)
            for block, (symbols, _) in zip(blocks, for_wrapper(blocks), strict=True):
                weights = settle(known[wrapper][symbols[0]], symbols)
                if weights is None:
                    raise ValueError("the wrapper was not made from this stream")
                for (i, _, own), s, w in zip(block, symbols, weights, strict=True):
                    if i >= 0 and is_template(s, own, w):
                        kinds.add(s.partition("__")[0])
                    elif i >= 0:
                        slots.append(i)
            rows.append((key, [x for x in LANGUAGES if x in kinds], slots))
        yield pd.DataFrame(rows, columns=["chunk_id", "kinds", "slots"])


def _prose(chunks: DataFrame) -> DataFrame:
    prose = chunks.where(F.col("rel_path").rlike(_PROSE) & F.col("content").isNotNull() & (F.col("content") != ""))
    return prose.select(F.col("id").alias("chunk_id"), F.coalesce("project_id", F.lit("")).alias("host"), "content")


def template_tokens(prose: DataFrame) -> DataFrame:
    """chunk_id, kinds (languages of the template tokens), slots (numbers of the tokens that are text) of prose texts.

    ``prose``: chunk_id, host, content. Each text is a stream of tokens; the
    streams of a host are aligned, line by line, into its wrapper. Tokens of
    whole constructs are template tokens. A broken one is where the wrapper
    item it matches is vouched for by a whole construct in some stream of the
    host, or by broken ones in two places (TEMPLATE_MIN). A lone symbol is
    where most lone symbols at its item stand in texts with other constructs
    of its language, however many there are (LONE_MIN). Otherwise it belongs
    to a text slot. Texts without tokens give no rows.
    """
    key = dict(prose.dtypes)["chunk_id"]
    signed = materialise(prose.mapInPandas(_sign, f"chunk_id {key}, host string, sig string").where("sig <> ''"))
    lines = materialise(signed.select("host", "sig").mapInPandas(_lines, "host string, lead string, items string").groupBy("host", "lead", "items").agg(F.count("*").alias("n")))
    made = wrappers(lines).groupBy("host").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lead", "items"))))).alias("wrapper"))
    made = materialise(made)
    sizes = materialise(signed.groupBy("host").agg(F.count("*").alias("__n")))
    whole = made.where(F.col("host") == ALL_HOSTS).select("wrapper").first()  # one row of some ten kB
    wrapper = F.when(F.col("__n") < HOST_MIN, F.lit(whole[0] if whole else "{}")).otherwise(F.col("wrapper"))
    side = sizes.join(made, "host").select("host", "__n", wrapper.alias("wrapper"))
    side = materialise(side)
    if side.limit(HOSTS_MAX + 1).count() <= HOSTS_MAX:
        joined = signed.join(F.broadcast(side), "host")
    else:
        joined = join_facts(signed, side, ["host"], "__n", signed.count())
    return joined.select("chunk_id", "sig", "wrapper").mapInPandas(_settle, f"chunk_id {key}, kinds array<string>, slots array<int>")


def markup_kinds(chunks: DataFrame) -> DataFrame:
    """chunk_id, markup (html, markdown, wiki, latex), each once, for prose chunks that carry that markup.

    ``chunks``: id, project_id (the host), rel_path, content. Only files ending
    in .md, .mdx, .txt, .rst, .tex or .html are prose. A chunk has the
    languages of its template tokens (``template_tokens``). Code keeps its
    content out of other languages. Null or empty contents and null paths give
    no rows, a null project is a host of its own, repeated rows count once,
    other columns are ignored.
    """
    return template_tokens(_prose(chunks)).select("chunk_id", F.explode("kinds").alias("markup")).distinct()


def clean(text: str, slots: frozenset[int] | set[int] = frozenset()) -> str:
    """Clean text of a marked-up one; the tokens with the numbers ``slots`` are text.

    Headings come as ``#`` lines, list items as ``-`` or ``1.`` lines, code in
    ``` fences or backticks, formulas as they were; table rows as cells joined
    by `` | ``; links, images and emphasis as their words; comments, scripts,
    templates and layout tags vanish; entities become their characters.
    """
    out: list[str] = []
    ordered: list[int | None] = []

    def brk(n: int = 1) -> None:
        tail = "".join(out[-3:])
        have = len(tail) - len(tail.rstrip("\n")) if tail else n
        out.append("\n" * max(0, n - have))

    for i, (s, m) in enumerate(tokens(re.sub(r"\r\n?", "\n", text))):
        if s in ("T", "") or i in slots:
            out.append(m if isinstance(m, str) else m.group(0))
            continue
        kind = s.partition("__")[2]
        if s == "markdown__fence" or s in ("latex__verbatim", "html__pre", "wiki__source"):
            body = m["fbody"] if s == "markdown__fence" else m["vbody"] if s == "latex__verbatim" else html.unescape(re.sub(r"<[^<>]*>", "", m["pbody"])) if s == "html__pre" else m["wbody"]
            brk()
            info = m["info"].strip() if s == "markdown__fence" else ""
            out.append(f"```{info}\n{body.strip(chr(10))}\n```")
            brk()
        elif s in ("markdown__code", "html__code"):
            out.append(m.group(0) if s == "markdown__code" else f"`{html.unescape(m['hbody'])}`")
        elif s in ("latex__display", "latex__math"):
            out.append(m.group(0))
        elif s in ("latex__heading", "wiki__heading", "markdown__heading", "markdown__setext"):
            level, title = {"latex__heading": lambda: (_LEVEL[m["lh"]], m["lht"]), "wiki__heading": lambda: (len(m["wh"]) - 1, m["wht"]), "markdown__heading": lambda: (len(m["mh"]), m["mht"]), "markdown__setext": lambda: (1 if m["sb"][0] == "=" else 2, m["sh"])}[s]()
            brk()
            out.append("#" * level + " " + clean_inline(title))
            brk()
        elif s == "latex__item":
            brk()
            if ordered and ordered[-1] is not None:
                ordered[-1] += 1
                out.append(f"{ordered[-1]}. ")
            else:
                out.append("- " + (m["it"] + " " if m["it"] else ""))
        elif s in ("markdown__task", "wiki__nested", "text__bullet"):
            number = re.match(r"\s*\d+", m.group(0)) if s == "text__bullet" else None
            out.append(f"{number.group(0).strip()}. " if number else "- ")
        elif s.startswith("latex__") and kind in ("itemize", "enumerate", "description"):
            if "begin" in m.group(0):
                ordered.append(0 if kind == "enumerate" else None)
            elif ordered:
                ordered.pop()
        elif s == "latex__command":
            out.append((" " if m.group(0).startswith("~") else "") + ("" if m["lc"] in ("label", "usepackage", "documentclass", "bibliographystyle", "includegraphics", "vspace", "hspace") else m["lct"] or ""))
        elif s == "html__entity":
            out.append(html.unescape(m.group(0)).replace("\xa0", " "))
        elif s == "wiki__row" or s == "markdown__row":
            out.append(" | ".join(clean_inline(c.strip()) for c in re.split(r"\|\|?", m["wr"] if s == "wiki__row" else m["mr"])))
        elif s == "wiki__table" and m.group(0).lstrip()[0] == "!":
            out.append(" | ".join(c.strip() for c in re.split(r"!!", m.group(0).lstrip()[1:])))
        elif s == "wiki__link":
            out.append("" if m["wns"] else m["wll"] or m["wlt"])
        elif s == "markdown__image":
            out.append(m["ia"])
        elif s == "markdown__link":
            out.append(m["la"])
        elif s == "markdown__auto":
            out.append(m.group(0)[1:-1])
        elif s == "markdown__em":
            out.append(m["em"] or m["em2"])
        elif s == "markdown__strike":
            out.append(m.group(0)[2:-2])
        elif s.startswith("html__"):
            tag = kind.lstrip("/")
            if tag in ("ol", "ul", "menu", "dir"):
                if kind[0] != "/":
                    ordered.append(0 if tag == "ol" else None)
                elif ordered:
                    ordered.pop()
                brk()
            elif kind in ("td", "th") and "".join(out[-1:]).strip():
                out.append(" | ")
            elif tag in ("td", "th"):
                pass
            elif kind == "li":
                brk()
                if ordered and ordered[-1] is not None:
                    ordered[-1] += 1
                out.append(f"{ordered[-1]}. " if ordered and ordered[-1] is not None else "- ")
            elif re.fullmatch(r"h[1-6]", kind):
                brk()
                out.append("#" * int(kind[1]) + " ")
            elif tag in _BLOCK_TAGS and kind != "/li":
                brk()
        # what is left (environments, templates, quotes, table lines, footnote marks, emphasis marks) has no text of its own
    flat = re.sub(r"[ \t]+\n", "\n", "".join(out))
    return re.sub(r"\n{3,}", "\n\n", flat).strip()


def clean_inline(text: str) -> str:
    """Clean one line, as in a heading or cell."""
    return clean(text).replace("\n", " ") if re.search(r"[\[\]{}<>*_`~'&\\$]", text) else text


def clean_chunks(chunks: DataFrame) -> DataFrame:
    """chunk_id, content (clean), kinds (markup kinds) of the prose chunks with markup, one row per id.

    What the wrapper calls text stays as it is. Of different rows of an id the
    greatest counts; rows without id are taken as they are.
    """

    def tidy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["content"] = [clean(t, set(x)) for t, x in zip(pdf["content"], pdf["slots"], strict=True)]
            yield pdf[["chunk_id", "content", "kinds"]]

    prose = one_per_key(_prose(chunks), "chunk_id")
    found = materialise(template_tokens(prose).where(F.size("kinds") > 0))
    key = dict(prose.dtypes)["chunk_id"]
    return prose.join(found, "chunk_id").mapInPandas(tidy, f"chunk_id {key}, content string, kinds array<string>")
