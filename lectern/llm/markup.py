"""Problem 1: markup residue in extracted texts.

Method: a linear-chain conditional random field over a text's leaf blocks, decoded
by Viterbi.  A text is parsed into the marks of all four languages, as leaves under the elements
that are open where they stand (HTML elements, LaTeX environments, wiki tables,
headings, list items, table rows, quotes, lines of code).  Features are the leaf's form and tag,
its ancestors, the signs around it, which languages stand beside it beyond doubt, and the
extraction's method.

Most forms are of one language, whatever stands around them; for these the chain only
says whether they are a mark at all.  The forms of ``OPEN`` are residue of a language in one text and
signs in another (asterisks, underscores, quotes, pipes, double braces, brackets after brackets).
They have no label of their own: a labeller settles those whose surroundings leave no
doubt, training sums over the rest, and what the chain says of them holds.  To the
corpus come ``SEEDS``, labelled pages of such signs as marks and as themselves, in the words of no site.

Code stays as it is: fenced code (each fence line opens or closes), inline code
and $ formulas are not residue, nor are # headings, `- ` and numbered lists, URLs and
unfilled template fields.

Training sees at most ``TRAIN_TEXTS`` texts (least key hashes); all texts are
decoded in full, where they are read, without a shuffle.

Results: null, empty and blank texts have no residue and come out as they are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.crf import Chain, bucket
from lectern.sources.tables import bounded_sample, in_batches

TRAIN_TEXTS = 2500
LABELS = ["clean", "html", "markdown", "wiki", "latex"]

#: The elements of HTML that occur in running text and pages.
TAGS = (
    "a abbr article aside b big blockquote body br button caption center cite code col dd del details div dl dt em fieldset figcaption figure font footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav ol option p pre q s samp script section select small span strike "
    "strong style sub summary sup table tbody td textarea tfoot th thead time title tr tt u ul var video wbr"
).split()

# name, label (None: the context decides), pattern; the first that matches at a place is the candidate
_FORMS: list[tuple[str, str | None, str]] = [
    ("codespan", "clean", r"(?<!`)(?P<_tick>`+)(?!`)[^\n]*?(?<!`)(?P=_tick)(?!`)"),
    ("formula", "clean", r"\$\$[^$]+\$\$|\$(?=[^\s$])[^$\n]*?(?<=[^\s$])\$(?!\d)"),
    ("field", None, r"\{\{ ?[\w.]+(?: ?\| ?\w+)?(?<!\|)\s?\}\}|\{%[^%\n]*%\}|<%[^\n]*?%>|[$#]\{[^{}\n]*\}|%\(\w+\)[sd]|%%\w+%%|\[(?:Your|First|Last|Product|Company|Service|Year|INSERT|Insert)\b[^\]\n]*\]"),
    ("comment", "html", r"<!--(?s:.*?)-->"),
    ("doctype", "html", r"<!(?i:doctype)\b[^>\n]*>"),
    ("tag", "html", r"</?(?i:{tags})(?=[\s/>])(?:\s+[^<>]*?)?/?>"),
    ("generic", "clean", r"(?<=\w)<[A-Za-z_]\w*(?:, ?\w+)*>"),
    ("entity", "html", r"&(?:\#\d{1,7}|\#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"),
    ("image", "markdown", r"!\[[^\[\]\n]*\]\([^()\n]*\)"),
    ("link", "markdown", r"(?<!\[)\[[^\[\]\n]+\]\([^()\s]*(?:\s+\"[^\"\n]*\")?\)"),
    ("footnote", "markdown", r"\[\^[^\]\s]+\]"),
    ("definition", None, r"(?m:^)\[[^\[\]\n]+\]:[ \t]+\S+"),
    ("checkbox", "markdown", r"(?m:^)[ \t]*[-*+] \[[ xX]\](?=\s)"),
    ("wikilink", "wiki", r"\[\[[^\[\]\n]+\]\]"),
    ("outlink", "wiki", r"\[(?:https?:)?//[^\s\]]+(?: [^\]\n]*)?\]"),
    ("reference", None, r"(?<!\[)\[[^\[\]\n]+\]\[[^\[\]\n]*\](?!\])"),
    ("template", None, r"\{\{[^{}\n]+\|[^{}\n]*\}\}"),
    ("rule", "markdown", r"(?m:^)[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*(?m:$)"),
    ("wikitable", "wiki", r"(?m:^)(?:\{\|[^\n]*|\|\}|\|-+(?![^\n]*\|)[^\n]*|\|[^|\n]+(?:\|\|[^\n]*)|![^\n]*!![^\n]*)"),
    ("magic", "wiki", r"__[A-Z]{3,}__"),
    ("wikihead", "wiki", r"(?m:^)(?P<_equal>={2,6}) ?[^=\n]+? ?(?P=_equal)[ \t]*(?m:$)"),
    ("quotes", None, r"'{2,5}(?=\S)[^'\n]+(?:'[^'\n]+)*?'{2,5}"),
    ("pipes", None, r"(?m:^)[ \t]*\|(?:[^|\n]*\|)+[ \t]*(?m:$)"),
    ("underline", "markdown", r"(?<=[^\s|>=-]\n)(?:={3,}|-{3,})[ \t]*(?m:$)"),
    ("path", "clean", r"\b[A-Za-z]:\\[\w\\.-]+"),
    ("url", "clean", r"(?:https?|ftp)://[^\s<>\"\])}|]+"),
    ("command", "latex", r"~?\\(?:begin|end|item|[a-zA-Z]+\*?(?=[\[{])|(?:hline|toprule|midrule|bottomrule|maketitle|tableofcontents|noindent|newpage|newline|par|centering|ldots|dots|cdots|times|alpha|beta|gamma|lambda|log|sum|int|infty|le|ge|quad|LaTeX|TeX)\b)\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})*"),
    ("break", "latex", r"\\\\(?=[ \t]*(?m:$))"),
    ("display", "latex", r"\\[\[\]()]"),
    ("strike", "markdown", r"~~(?=\S)[^~\n]+?(?<=\S)~~"),
    ("stars", None, r"(?<![\w*\\])(?P<_star>\*{1,3})(?=[^\s*])[^*\n]*?(?<=[^\s*])(?P=_star)(?![\w*])"),
    ("scores", None, r"(?<![\w_\\])(?P<_score>_{1,3})(?=[^\s_])[^_\n]*?(?<=[^\s_])(?P=_score)(?![\w_])"),
    ("quote", "markdown", r"(?m:^)>[ \t]?(?=\S)"),
    ("star", None, r"(?<=\d )\*(?= \d)|(?<=\w)\*(?=\s)"),
    ("less", None, r"(?<=\s)[<>&](?=\s)|(?<=[A-Z])&(?=[A-Z])"),
    ("set", "clean", r"\{\d[\d, ]*\}|\[\d[\d, ]*\]"),
    ("money", "clean", r"\$\d[\d.,]*"),
]


_CANDIDATE = re.compile("|".join(f"(?P<{name}>{p.replace('{tags}', '|'.join(TAGS))})" for name, _, p in _FORMS))
_LABEL = {name: label for name, label, _ in _FORMS}
#: Forms whose label their surroundings decide, and the label they have more often than not.
OPEN = {"template": "wiki", "field": "clean", "reference": "markdown", "definition": "markdown", "quotes": "wiki", "pipes": "markdown", "stars": "markdown", "scores": "markdown", "star": "clean", "less": "clean"}
_NESTING = frozenset("pipes wikitable wikihead link outlink command stars strike scores quotes definition".split())
#: Where a candidate can begin; only there the forms are tried.
_START = re.compile(r"(?m:^)[ \t]*(?:[-*+] \[|\||:?-{2}|==|!|>)|[`$%<&\[*~\\{]|!\[|''|(?<!\w)_|https?://|ftp://|\b[A-Za-z]:\\|(?<=\n)={3}")
_FENCE = re.compile(r"(?m)^[ \t]*(?:```|~~~)[^\n]*$")


def outside(text: str) -> list[tuple[int, int]]:
    """The spans of a text that are not fenced code."""
    if "```" not in text and "~~~" not in text:
        return [(0, len(text))]
    spans, start = [], 0
    for m in _FENCE.finditer(text):
        if start is None:
            start = m.end()
        else:
            spans.append((start, m.start()))
            start = None
    if start is not None:
        spans.append((start, len(text)))
    return spans


def marks(text: str) -> list[tuple[str, int, int]]:
    """(form, start, end) of the candidate marks outside fenced code."""
    out = []
    for a, b in outside(text):
        part, at = text[a:b], 0
        while (m := _START.search(part, at)) is not None:
            at = m.start()
            found = _CANDIDATE.match(part, at)
            if found is None and m.end() - at > 1 and part[at] in " \t":
                # white space at a line's start belongs to some forms only
                at = m.end() - 1
                found = _CANDIDATE.match(part, at)
            if found is None or found.end() == at:
                at += 1
                continue
            out.append((found.lastgroup, a + at, a + found.end()))
            if found.lastgroup in _NESTING:
                # marks may stand inside; go on behind the opening sign
                first = part[at]
                while at < found.end() and part[at] == first:
                    at += 1
            else:
                at = found.end()
    return out


_VOID = frozenset("br hr img input meta link wbr".split())
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)|\\([a-zA-Z]+)")
_ENVIRONMENT = re.compile(r"~?\\(begin|end)\{([^{}]*)\}")
_NUMBERED = re.compile(r"\d+[.)] ")
#: A line of code, by its end, a call, a comparison, an arrow or the word that begins it.
_CODE_LINE = re.compile(r"(?:(?<!\{)\{|(?<!\})\}|;(?<!&\w{2};)(?<!&\w{3};)(?<!&\w{4};)(?<!&\w{5};))\s*$|\w\([\w\s,.*&'\"]*\)|(?<!=)[=!<>]=(?!=)|(?<!-)->|=>|:=|^\s*(?:def|class|import|from|return|let|const|var|int|char|for|if|while|assert|print|SELECT|INSERT|sudo)\b|^\s*(?:>>> |\$ |#include)")
#: A table's line is no line of code.
_ROW = re.compile(r"^\s*[|!{]")
_LINES = {"#": "heading", "=": "heading", "-": "item", "*": "item", "+": "item", ":": "item", "|": "row", "!": "row", ">": "quote"}
#: Leaves on either side whose languages a leaf is told.
AROUND = 4


class Leaf:
    """A mark in its place: form, start, end, the open elements around it, its line, and the languages that stand beside it beyond doubt."""

    __slots__ = ("a", "b", "beside", "code", "form", "line", "path")

    def __init__(self, form: str, a: int, b: int, path: str, line: str, code: bool) -> None:
        self.form, self.a, self.b, self.path, self.line, self.code, self.beside = form, a, b, path, line, code, ""


def _close(stack: list[str], name: str) -> None:
    """Closes the innermost element of that name and what is open in it."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i] == name:
            del stack[i:]
            return


def leaves(text: str) -> list[Leaf]:
    """The leaf blocks of a text in order, under the elements that are open where they stand."""
    out: list[Leaf] = []
    stack: list[str] = []
    end, kind, code = -1, "", False
    for form, a, b in marks(text):
        if a >= end:
            at, end = text.rfind("\n", 0, a) + 1, text.find("\n", a)
            end = len(text) if end < 0 else end
            line = text[at:end]
            bare = line.lstrip()
            kind = _LINES.get(bare[:1]) or ("item" if _NUMBERED.match(bare) else "text")
            code = _CODE_LINE.search(line) is not None and not _ROW.match(line)
        out.append(Leaf(form, a, b, "/".join(stack[-2:]), kind, code))
        if form == "tag":
            name = _TAG.match(text, a).group(1).lower()
            if text[a + 1] == "/":
                _close(stack, name)
            elif name not in _VOID and text[b - 2] != "/":
                stack.append(name)
        elif form == "command" and (m := _ENVIRONMENT.match(text, a)):
            if m.group(1) == "begin":
                stack.append(f"env:{m.group(2)}")
            else:
                _close(stack, f"env:{m.group(2)}")
        elif form == "wikitable" and text.startswith("{|", a):
            stack.append("{|")
        elif form == "wikitable" and text.startswith("|}", a):
            _close(stack, "{|")
    for i, leaf in enumerate(out):
        if leaf.form in OPEN:
            leaf.beside = "+".join(sorted({x for y in out[max(0, i - AROUND) : i + AROUND + 1] if (x := _LABEL[y.form]) and x != "clean"}))
    return out


def _kind(c: str) -> str:
    return "^" if not c else "n" if c == "\n" else "s" if c.isspace() else "d" if c.isdigit() else "U" if c.isupper() else "a" if c.isalpha() else c


def features(text: str, leaf: Leaf, before: str, method: str) -> tuple[str, ...]:
    form, a, b = leaf.form, leaf.a, leaf.b
    mark = text[a:b]
    tag = _TAG.match(mark)
    out = (
        f"f={form}", f"f={form}/{_kind(text[a - 1 : a])}/{_kind(text[b : b + 1])}", f"t={form}/{(tag.group(1) or tag.group(2)).lower() if tag else mark[:2]}",
        f"p={form}/{before}", f"m={method}/{form}", f"l={form}/{leaf.line}", f"n={form}/{min(b - a, 200).bit_length()}", f"a={form}/{leaf.path}",
    )
    if form not in OPEN:
        return out
    inner = mark.strip("*_'{}[]| ")
    return (
        *out, f"c={form}/{leaf.code}", f"b={form}/{leaf.beside}", f"cb={form}/{leaf.code}/{leaf.beside}", f"code={leaf.code}/{leaf.beside != ''}",
        f"i={form}/{_kind(inner[:1])}/{_kind(inner[-1:])}/{' ' in inner}", f"e={form}/{'=' in mark}/{min(mark.count('|'), 4)}/{'.' in mark}/{mark[2:3] == ' '}",
    )


_SIGN_FIELD = re.compile(r"[$#%<\[]|\{%|\{\{ ?\w+\.")


def settled(text: str, leaf: Leaf) -> int:
    """The labeller: the label of a leaf of an open form whose surroundings leave no doubt, else -1."""
    form, a, b = leaf.form, leaf.a, leaf.b
    markdown, wiki = "markdown" in leaf.beside, "wiki" in leaf.beside
    label = None
    if form in {"star", "less"}:
        # between blanks, behind a word that no other asterisk comes before, or between capitals as in a name, a sign means itself
        blank = text[a - 1 : a].isspace() and text[b : b + 1].isspace()
        lone = form == "star" and "*" not in text[max(0, a - 80) : a] and not leaf.beside
        label = "clean" if blank or lone or (form == "less" and text[a - 1 : a].isupper() and text[b : b + 1].isupper()) else None
    elif form == "field":
        label = "clean" if _SIGN_FIELD.match(text, a) else None
    elif form in {"template", "quotes"}:
        # named arguments are a template's
        label = "wiki" if not leaf.code and (wiki or form == "template" and "=" in text[a:b]) else "clean" if leaf.code and not wiki else None
    elif form in {"stars", "scores"}:
        label = "markdown" if markdown and not leaf.code else "clean" if leaf.code and not leaf.beside else None
    elif form == "pipes":
        label = "markdown" if markdown and not wiki else "clean" if leaf.code and not leaf.beside else None
    elif form == "reference":
        name = text[text.rfind("[", a, b) + 1 : b - 1]
        label = "markdown" if name and f"[{name}]: " in text else "clean" if text[a - 1 : a].isalnum() else None
    elif form == "definition":
        label = "markdown" if text.count(text[a : text.find("]", a) + 1]) > 1 else None
    return -1 if label is None else LABELS.index(label)


def examples(text: str, method: str, label: str | None = None) -> list[tuple[list[int], int]]:
    """Features and label of each leaf; ``label`` is that of the open forms of a labelled page."""
    out, before = [], "^"
    for leaf in leaves(text):
        fixed = _LABEL[leaf.form]
        y = LABELS.index(fixed) if fixed is not None else settled(text, leaf) if label is None else LABELS.index(label)
        out.append(([bucket(n) for n in features(text, leaf, before, method)], y))
        before = leaf.form
    return out


#: Labelled pages: signs that are marks, and the same signs as themselves, in the words of no site.
SEEDS: list[tuple[str, str]] = [
    ("The **first** step is *short* and the __last__ one is _long_.", "markdown"),
    ("A *single* word.\n\nSee [the page](https://x.example) for **more**.", "markdown"),
    ("**Note:** read this *before* you start.", "markdown"),
    ("Move it, then __open__ the door again.", "markdown"), ("When the bell rings, __stop__ and __wait__ for them.", "markdown"), ("Only *two* of them came. That is __too__ few.", "markdown"),
    ("- [x] a **bold** task\n- [ ] an _open_ one", "markdown"),
    ("| name | size |\n|------|------|\n| a | 1 |\n| b | 2 |", "markdown"),
    ("See [the guide][g] and [notes][n].\n\n[g]: https://x.example/g\n[n]: https://x.example/n", "markdown"),
    ("Read [this][ref] first[^1].\n\n[ref]: https://x.example \"Title\"", "markdown"),
    ("The '''city''' lies on the [[river]].\n== History ==\nIt was ''founded'' late. {{citation needed|date=May}}", "wiki"),
    ("'''Name''' is a [[town]] in the north.", "wiki"), ("{{infobox|name=x|size=3}}\n'''X''' is a [[lake]].", "wiki"), ("A ''small'' word and a '''big''' one.", "wiki"),
    ("=== Notes ===\n: ''see also'' [[Other]]", "wiki"), ("{{note|a=b}} stands alone in a sentence.", "wiki"),
    ("int *a = *b; char **p = &q;\nfoo(*x, *y);", "clean"), ("result = a *b* c; total = x*y*z;", "clean"), ("def f(*args, **kwargs):\n    return g(*args, **kwargs)", "clean"),
    ("class A:\n    def __init__(self):\n        self.__name__ = __file__", "clean"), ("if (__name__ == '__main__'): run(__path__)", "clean"),
    ("x = '''text of a string'''\nprint('''more''')", "clean"), ("s = ''; t = 'a'; u = f('', 'b')", "clean"), ("def f():\n    '''Return the value.'''\n    return g(x)", "clean"),
    ("cell = a[i][j] + b[row][0];", "clean"), ("grid[x][y] = grid[y][x]", "clean"), ("The cost is 3 * 4 * 5 and 2 * 2.", "clean"), ("where a < b & c > d holds", "clean"),
    ("{{ user.name | upper }} greets {{ page.title }}", "clean"), ("<li>{{ item.name|escape }}</li> for (x of items) { }", "clean"), ("Dear {{ name }}, your order {{ id }} is here.", "clean"), ("echo {{ value|default('x') }};", "clean"),
    ("value = {{ x|int }};", "clean"), ("f({{ y|length }}, 2);", "clean"), ("join({{ words|join(', ') }}, {{ sep }});", "clean"), ("if ({{ flag|bool }}) { run(); }", "clean"),
    ("cat log.txt | grep x | sort\n$ ls | wc", "clean"), ("if (a || b || c) { return x | y | z; }", "clean"), ("files *.txt and *.md match a*", "clean"),
]


def train(texts: list[tuple[str, str]]) -> Chain:
    """texts: (text, method)"""
    # long texts are cut into pages of 200 marks for training
    pages = [e[i : i + 200] for t, m in texts if t for e in [examples(t, m)] for i in range(0, len(e), 200)]
    # labelled pages weigh as much as a thirtieth of the corpus
    seeds = [examples(t, "", label) for t, label in SEEDS] * max(1, len(pages) // (30 * len(SEEDS)))
    return Chain(LABELS).train(pages + [e for e in seeds if e], rounds=50)


class Decoder:
    def __init__(self, chain: Chain) -> None:
        self.chain = chain
        self.scores: dict[tuple[str, ...], list[float]] = {}

    def __call__(self, text: str, method: str) -> list[tuple[str, int, int, str]]:
        """(form, start, end, label) of all marks."""
        found = leaves(text)
        scores, before = [], "^"
        if len(self.scores) > 200_000:
            self.scores.clear()
        for leaf in found:
            key = features(text, leaf, before, method)
            s = self.scores.get(key)
            if s is None:
                s = self.scores[key] = self.chain.emission([bucket(n) for n in key])
            scores.append(s)
            before = leaf.form
        labels = self.chain.decode(scores)
        # of a form that is of one language the chain says only whether it is a mark
        return [(x.form, x.a, x.b, LABELS[y] if _LABEL[x.form] in {None, LABELS[y]} else "clean") for x, y in zip(found, labels, strict=True)]

    def overruled(self, text: str, method: str) -> tuple[int, int, int]:
        """Leaves of open forms; of these, usual marks that the chain took for signs or another language's, and usual signs that it took for marks."""
        rows = [(OPEN[f], label) for f, _, _, label in self(text, method) if f in OPEN]
        return len(rows), sum(u != "clean" and u != y for u, y in rows), sum(u == "clean" != y for u, y in rows)


# conversion


_LEVEL = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}


def _plain(form: str, mark: str) -> str:
    """What a mark leaves behind in clean text."""
    if form == "entity":
        return html.unescape(mark)
    if form in {"comment", "doctype", "magic", "rule", "underline", "break", "display"}:
        return ""
    if form == "tag":
        name = re.match(r"</?([A-Za-z0-9]+)", mark).group(1).lower()
        if re.match(r"h[1-6]$", name) and mark[1] != "/":
            return "\n" + "#" * int(name[1]) + " "
        if name == "li":
            return "" if mark[1] == "/" else "\n- "
        return "\n" if name in {"br", "p", "div", "tr", "table", "ul", "ol", "blockquote", "pre"} or name[0] == "h" and name[1:].isdigit() else " " if name in {"td", "th"} else ""
    if form in {"image", "link", "reference"}:
        return re.match(r"!?\[([^\]]*)\]", mark).group(1)
    if form in {"footnote", "definition"}:
        return ""
    if form == "checkbox":
        return re.sub(r"[-*+] \[[ xX]\]", "-", mark)
    if form == "wikilink":
        inner = mark[2:-2]
        return "" if re.match(r"(?i)(?:category|file|image|kategorie|catégorie|categoría):", inner) else inner.split("|")[-1]
    if form == "outlink":
        return mark[1:-1].partition(" ")[2]
    if form == "template":
        return ""
    if form == "wikitable":
        return "" if mark[:2] in {"{|", "|}", "|-"} else " ".join(x.strip() for x in re.split(r"\|\||!!", mark[1:]))
    if form == "wikihead":
        level = len(re.match(r"=+", mark).group())
        return "#" * level + " " + mark.strip().strip("=").strip()
    if form in {"quotes", "strike", "stars", "scores"}:
        return re.sub(r"^(['~*_]+)(.*?)['~*_]+$", r"\2", mark, flags=re.S)
    if form == "pipes":
        return " ".join(x.strip() for x in mark.strip().strip("|").split("|"))
    if form == "quote":
        return ""
    if form == "command":
        mark = mark.lstrip("~")
        m = re.match(r"\\([a-zA-Z]+)\*?(?:\[[^\]]*\])?", mark)
        name, arguments = m.group(1), re.findall(r"\{([^{}]*)\}", mark)
        if name in {"begin", "end"}:
            return "$$" if arguments and re.match(r"(?:equation|align|displaymath|gather|math)\*?$", arguments[0]) else ""
        if name == "item":
            return "-"
        if name in _LEVEL and arguments:
            return "#" * _LEVEL[name] + " " + arguments[0]
        if name in {"label", "ref", "cite", "eqref", "pageref", "hline", "centering", "maketitle", "noindent", "newpage"}:
            return ""
        if name == "footnote" and arguments:
            return f" ({arguments[0]})"
        return arguments[0] if arguments else mark
    return mark


def convert(text: str, found: list[tuple[str, int, int, str]]) -> str:
    """The text with its residue turned into plain text; code, formulas, headings and lists stay."""
    out, at, formula = [], 0, False
    for form, a, b, label in found:
        if label == "clean" or a < at:
            continue
        mark = text[a:b]
        if label == "latex" and re.match(r"\\begin\{(?:equation|align|displaymath|gather|math)", mark):
            formula = True
        elif label == "latex" and re.match(r"\\end\{(?:equation|align|displaymath|gather|math)", mark):
            formula = False
        elif formula:
            continue  # formulas keep their commands
        out += [text[at:a], _plain(form, mark)]
        at = b
    out.append(text[at:])
    return re.sub(r"\n{3,}", "\n\n", "".join(out)) if len(out) > 1 else text


def decoded(texts: DataFrame, key: str = "file_id", text: str = "text", method: str = "method", clean: bool = False) -> DataFrame:
    """(key, markup: the languages of its residue) per row, and on demand the clean text."""
    sample = bounded_sample(texts.select(key, text, method), key, TRAIN_TEXTS)
    chain = train([(r[text], r[method] or "") for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(chain)
        for batch in batches:
            languages, cleaned = [], []
            for t, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = decode(t, m or "") if t else []
                languages.append(sorted({label for *_, label in found} - {"clean"}))
                if clean:
                    before = set()  # no text twice, so that it ends
                    while any(label != "clean" for *_, label in found):  # marks inside marks come to light one level at a time
                        before.add(hash(t))
                        t = convert(t, found)
                        if hash(t) in before:
                            break
                        found = decode(t, m or "")
                    cleaned.append(t)
            arrays = [batch.column(0), pa.array(languages, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(cleaned, pa.string())] if clean else []), names=[key, "markup"] + ([text] if clean else []))

    schema = f"`{key}` {texts.schema[key].dataType.simpleString()}, markup array<string>" + (f", `{text}` string" if clean else "")
    return in_batches(texts.select(key, text, method), run, schema)
