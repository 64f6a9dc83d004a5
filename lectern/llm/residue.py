"""Problem 5: template residue, filler, error pages and demands for scripts.

Method: a regularised linear classifier (softmax) on hashed n-grams, length and
title features, trained on weak labels from phrases and from the status a page's
title or a crawl's error states, and validated on hosts unseen in training.

The unit is a sentence.  A page is a case if every sentence of its main body
(found by the chain of ``pages``), the title aside, is residue; its kind is that
of most of its text.  A crawl's entry is a case if the whole of it, or what
stands in place of the url or the reason, is residue.

Bound: the classifier sees at most ``SAMPLE_PAGES`` pages and ``SAMPLE_CRAWLS``
crawls (least key hashes), and of their content sentences ``CONTENT_PER_RESIDUE`` for each of residue.  All rows are judged, in full, where they are read.

Results: null, empty and blank texts, answers that aren't HTML and pages without any main text
are no cases, unless a page has nothing but its noscript text and that demands scripts.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np

from lectern.llm.crf import DIM, bucket
from lectern.llm.pages import Block, Reader, clean

SAMPLE_PAGES, SAMPLE_CRAWLS = 3000, 5000
#: Of the sample's sentences that are content, as many are fitted as this many for each of residue, and this many at least.
CONTENT_PER_RESIDUE, LEAST_CONTENT = 3, 4000
KINDS = ["content", "placeholder", "filler", "error", "script", "aside"]
CONTENT, PLACEHOLDER, FILLER, ERROR, SCRIPT, ASIDE = range(6)

#: Unfilled or wrongly filled template fields, and parts still to be written.
_FIELD = re.compile(
    r"\{\{[^{}]*\}\}|\{%[^%]*%\}|[$#]\{[^{}]*\}|<%.*?%>|%\(\w+\)[sdf]|(?<![\w%])%[sd](?!\w)|%%\w+%%|@@\w+@@|\[object \w+\]|\bundefined\b|\bNaN\b|"
    r"\[(?:Your|First|Last|Insert|INSERT|Product|Company|Service|Year|Name|Title|Date|City|TODO|TBD)\b[^\]\[]*\]|\{\w+(?::[^{}]*)?\}|"
    r"^\s*(?:TODO|TBD|FIXME|TBA|XXX)\b|\b(?:to be (?:written|announced|determined)|coming soon)\b"
)
#: Words of the usual stand-in text.
_LATIN = re.compile(r"(?i)\b(?:lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|eiusmod|tempor|incididunt|labore|dolore|magna|aliqua|enim|minim|veniam|quis|nostrud|ullamco|laboris|nisi|aliquip|commodo|consequat|duis|aute|irure|velit|esse|cillum|fugiat|pariatur)\b")
_FILLER = re.compile(r"(?i)\b(?:lorem ipsum|sample text|dummy text|blind ?text|placeholder text|stand-?in text|asdf|qwerty|your own words|foo bar baz|texte de remplissage|texto de (?:relleno|ejemplo)|platzhaltertext)\b|示例文本|ダミーテキスト")
_SCRIPT = re.compile(
    r"(?i)(?:enable|activate|turn(?:ed)? on|switch on|require[sd]?|allow|need|needs|aktivieren|activez|active|activer|habilite|activar|erlauben|autorise[rz]).{0,40}\b(?:java ?script|scripts?|scripting)\b|"
    r"\b(?:java ?script|scripts?|scripting)\b.{0,40}(?:is (?:required|disabled|off)|required|must be (?:allowed|enabled|on)|be allowed|turned (?:on|off)|aktivieren|einschalten|activé|activado|blocked)|"
    r"browser blocks scripts|checking your browser|(?:启用|開啟|开启|打开|有効).{0,6}(?:java ?script|脚本|スクリプト)|(?:java ?script|スクリプト|脚本).{0,6}(?:启用|有効|打开|开启)"
)
_ERROR = re.compile(
    r"(?i)\b(?:(?:40[0-9]|41[0-9]|429|50[0-9]) (?:not found|bad gateway|forbidden|unauthorized|gone|internal|service|gateway|too many)|(?:page|address|document|site|file).{0,40}(?:could not be found|not found|no longer available|never existed)|could not be found|"
    r"nothing (?:is )?(?:at|lives at|lives) (?:this|that)?|sorry, (?:there is )?nothing|something went wrong|internal server error|bad gateway|invalid answer|service unavailable|temporarily unavailable|down for maintenance|under maintenance|"
    r"access (?:is )?denied|do(?:es)? not have permission|you do not have|not authori[sz]ed|forbidden|too many requests|slow down and|session has expired|sign in again|was withdrawn|been withdrawn|fatal error|uncaught exception|stack ?trace|traceback|please try again|"
    r"existiert (?:leider )?nicht|nicht gefunden|serverfehler|versuchen sie es später|wartungsarbeiten|zugriff verweigert|sitzung (?:ist )?abgelaufen|"
    r"introuvable|n'existe pas|erreur est survenue|réessayez plus tard|en maintenance|accès refusé|session a expiré|"
    r"no hemos encontrado|no encontrad[ao]|algo salió mal|inténtelo de nuevo|error del servidor|acceso denegado|en mantenimiento|sesión ha caducado)\b|"
    r"页面不存在|已被删除|服务器错误|访问被拒绝|维护中|稍后再试|见つかりません|見つかりません|存在しません|エラーが発生|アクセスが拒否|メンテナンス"
)
_ASIDE = re.compile(r"(?i)^(?:go |return |take me )?back to (?:the )?(?:start|home|front)|^zurück zur (?:start|haupt)|^retour(?:nez)? à l'accueil|^volver (?:al|a la) (?:inicio|página principal)|^返回首页|^ホームに戻る|トップページへ")
#: Titles that state a status.
_STATUS = re.compile(r"(?i)^(?:error\b|oops|(?:fehler|erreur|error)? ?[45]\d\d\b|.{0,20}not found|access denied|service unavailable|.*(?:nicht gefunden|introuvable|no encontrada|页面不存在|見つかりません)|error del servidor|erreur$)")
#: A plain reason, as a reader reports it: a status, or a few lower-case words.
_PLAIN = re.compile(r"^(?:http )?(?:status:? ?)?\d{3}(?: [A-Za-z]+){0,3}$|^[a-z][\w /:.,-]{0,80}$|^[A-Z][a-z]+(?: [A-Z]?[a-z]+){0,3}$")

_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^\s\d])|(?<=[。！？])\s*")
_WORD = re.compile(r"[^\W\d_]+|\d+|\{\{|\}\}|\{%|%\}|<%=?|%>|\$\{|#\{|%\(|%%|@@|[\[\]{}%<>]")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _SENTENCE.split(text)) if s]


def weak(sentence: str) -> int:
    """The labeller: a kind, or -1."""
    words = sentence.split()
    if "“" in sentence or "«" in sentence:
        return -1  # what is quoted is spoken of
    if _ASIDE.search(sentence):
        return ASIDE
    if _FIELD.search(sentence):
        return PLACEHOLDER
    latin = len(_LATIN.findall(sentence))
    if _FILLER.search(sentence) or (latin >= 3 and latin * 2 >= len(words)) or (len(words) >= 4 and len({w.lower() for w in words}) <= max(2.0, 0.9 * len(words) ** 0.5)):
        return FILLER
    if _SCRIPT.search(sentence):
        return SCRIPT
    if _ERROR.search(sentence):
        return ERROR
    return -1


def features(sentence: str, title: str = "") -> list[int]:
    low = [w.lower() for w in _WORD.findall(sentence)]
    names = {"bias", f"n={min(len(low), 64).bit_length()}"}
    prior = "^"
    for w in low:
        if _WIDE.match(w):
            names.update(f"c={w[i : i + 2]}" for i in range(max(1, len(w) - 1)))
            w = "wide"
        if w.isdigit():
            w = "0"
        names.add(f"w={w}")
        names.add(f"b={prior} {w}")
        prior = w
    names.add(f"b={prior} $")
    if low:
        # distinct words grow about as the root of a text's length, unless it repeats itself
        names.add(f"u={min(4, int(2 * len(set(low)) / len(low) ** 0.5))}")
    latin = len(_LATIN.findall(sentence))
    names.add(f"l={4 * latin // max(1, len(low))}")
    names.add(f"q={'“' in sentence or '"' in sentence}")
    for w in _WORD.findall(title.lower())[:8]:
        names.add("t=0" if w.isdigit() else f"t={w}")
    return [bucket(n) for n in names]


class Judge:
    """The trained classifier; verdicts on sentences seen before are kept."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights
        self.known: dict[tuple[str, str, bool], int] = {}

    def __reduce__(self):
        return Judge, (self.weights.astype(np.float32),)

    def kind(self, sentence: str, title: str = "", residue: bool = False) -> int:
        """The likeliest kind; with ``residue`` of those that aren't content."""
        # a title counts where it states something of its own; most titles only name their page
        title = title if _STATUS.search(title) or weak(title) >= 0 else ""
        key = (sentence, title, residue)
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            scores = self.weights[features(sentence, title)].sum(0)
            self.known[key] = int(scores[residue:].argmax()) + residue
        return self.known[key]


def fit(examples: list[tuple[str, str, int]], rounds: int = 110, rate: float = 0.2, penalty: float = 0.001) -> Judge:
    """examples: sentence, title, kind.  Adam on the penalised likelihood, classes weighted by a power of their rarity."""
    k = len(KINDS)
    rows = [features(s, t if _STATUS.search(t) or weak(t) >= 0 else "") for s, t, _ in examples]
    y = np.array([e[2] for e in examples])
    of = np.repeat(np.arange(len(rows)), [*map(len, rows)])
    used, local = np.unique(np.concatenate([np.array(r) for r in rows]), return_inverse=True)
    counts = np.bincount(y, minlength=k)
    share = ((len(y) / np.maximum(counts, 1)) ** 0.75)[y]
    share /= share.sum()
    goal = np.eye(k)[y]
    w, first, second = np.zeros((len(used), k)), 0.0, 0.0
    for r in range(1, rounds + 1):
        score = np.stack([np.bincount(of, w[local, j], len(rows)) for j in range(k)], 1)
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        gap = (goal - p) * share[:, None]
        g = np.stack([np.bincount(local, gap[of, j], len(used)) for j in range(k)], 1) - penalty * w / len(used) ** 0.5
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w = w + rate * (first / (1 - 0.9**r)) / (np.sqrt(second / (1 - 0.99**r)) + 1e-8)
    weights = np.zeros((DIM, k))
    weights[used] = w
    return Judge(weights)


def page_parts(title: str, blocks: list[Block], labels: list[int], raw: str) -> list[tuple[str, bool]]:
    """(sentence, is code) of what a page has for its main body; where that is empty, of its loose text, then its noscript text."""
    own = title.split(" | ")[0].strip().lower()
    parts = []
    for b, y in zip(blocks, labels, strict=True):
        if y and b.tag != "h1" and b.text and not (b.text.lower() == own and b.tag[0] in "ht"):
            parts += [(b.text, True)] if b.tag == "pre" else [(s, False) for s in sentences(b.text)]
    if not parts and not any(b.linked for b in blocks):
        loose = [b.text for b in blocks if b.tag != "h1" and b.text and b.text.lower() != own] or [clean(re.sub(r"<[^<>]*>", " ", x)) for x in re.findall(r"(?is)<noscript\b[^>]*>(.*?)(?:</noscript\s*>|\Z)", raw)]
        parts = [(s, False) for x in loose for s in sentences(x)]
    return parts


def page_kind(judge: Judge, title: str, blocks: list[Block], labels: list[int], raw: str) -> str | None:
    """The kind of residue that is all of a page's main body; None for content."""
    title = title.split(" | ")[0]
    sizes: Counter[int] = Counter()
    parts = page_parts(title, blocks, labels, raw)
    for sentence, code in parts:
        kind = CONTENT if code else judge.kind(sentence, title)
        if kind == CONTENT:
            return None
        sizes[kind] += len(sentence)
    sizes.pop(ASIDE, None)
    if not sizes:
        # the body is furniture as far as the chain can tell: a sentence that is surely residue still gives it away
        if parts or not blocks or any(y and b.tag != "h1" and b.text for b, y in zip(blocks, labels, strict=True)):
            return None
        for b in blocks:
            if not b.linked and b.tag not in {"h1", "li"} and not b.flags & 287 and b.text:
                sizes.update(k for s in sentences(b.text) if (k := judge.kind(s, title)) not in {CONTENT, ASIDE} and weak(s) == k)
    return KINDS[max(sizes, key=lambda k: (sizes[k], -k))] if sizes else None


def _spread(kinds: list[int], texts: list[str]) -> list[int]:
    """A short sentence right after a residue sentence (a trace number, say) belongs to it, as does one right before it that isn't a sentence."""
    out = list(kinds)
    for i, t in enumerate(texts):
        if out[i] == -1 and len(t) < 40:
            if i and out[i - 1] in {ERROR, SCRIPT, PLACEHOLDER}:
                out[i] = out[i - 1]
            elif i + 1 < len(out) and kinds[i + 1] in {ERROR, SCRIPT} and (t.endswith(("...", "…", "!")) or len(t) < 10):
                out[i] = kinds[i + 1]
    return out


def page_sentences(pages: Iterable[tuple[str, list[Block], list[int], str]]) -> tuple[list[tuple[str, str, int]], list[tuple[str, str, int]]]:
    """Weakly labelled sentences of pages (title, blocks, labels, raw): residue, and content."""
    out, contents = [], []
    for title, blocks, labels, raw in pages:
        title = title.split(" | ")[0]
        parts = page_parts(title, blocks, labels, raw)
        kinds = [CONTENT if code else weak(s) for s, code in parts]
        kinds = _spread(kinds, [s for s, _ in parts])
        plain = sum(k == -1 or c for k, (_, c) in zip(kinds, parts, strict=True))
        status = bool(_STATUS.search(title))
        for (s, code), k in zip(parts, kinds, strict=True):
            if plain >= 3 and plain * 2 >= len(parts) and not status:
                contents.append((s, title, CONTENT))  # also sentences that only mention such things
            elif k >= 0 and not code:
                out.append((s, title, k))
            elif code or not status:
                contents.append((s, title, CONTENT))
            elif status:
                out.append((s, title, ERROR))
    return out, contents


def page_examples(pages: Iterable[tuple[str, list[Block], list[int], str]]) -> list[tuple[str, str, int]]:
    """Examples to train on: all residue, and content in proportion."""
    out, contents = page_sentences(pages)
    return out + contents[: max(LEAST_CONTENT, CONTENT_PER_RESIDUE * len(out))]


#: Examples of each kind in the words of no site, so that a kind without a case in the sample isn't unknown.
SEEDS = [
    *[(s, "", PLACEHOLDER) for s in ("{{ body }}", "${description}", "<%= content %>", "%s", "[Insert text here]", "TODO: write this section", "TBD", "@@BODY@@", "[object Object]", "undefined", "%%BODY%%", "{url}: {err}", "{{ reason }}")],
    *[(s, "", FILLER) for s in ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "text text text text text text", "asdf asdf jkl asdf", "This is sample text.", "sample text sample text sample text")],
    *[(s, "", ERROR) for s in ("The page you were looking for could not be found.", "Internal Server Error", "502 Bad Gateway", "Access denied.", "Your session has expired.", "We are down for maintenance.", "Seite nicht gefunden.", "Page introuvable.", "La page demandée n'existe pas.", "La page a été déplacée.", "Une erreur est survenue.", "Página no encontrada.", "Algo salió mal.", "Interner Serverfehler.", "页面不存在", "ページが見つかりません", "This document is no longer available.", "Oops! Something went wrong.")],
    *[(s, "", SCRIPT) for s in ("Please enable JavaScript.", "You need to enable JavaScript to run this app.", "Bitte aktivieren Sie JavaScript.", "Activez JavaScript.", "Active JavaScript para continuar.", "请启用JavaScript后再访问。", "JavaScriptを有効にしてください。", "Checking your browser before opening the site.", "Scripts must be allowed.")],
    *[(s, "", ASIDE) for s in ("Go back to the start page.", "Back to the home page.", "Zurück zur Startseite.", "Retour à l'accueil.")],
]


# crawls


_TAGS = re.compile(r"<[^<>]*>")
#: Stands for the title of an answer that is quoted as a reason.
_ANSWER = "Error"
_PAGE = re.compile(r"(?i)\s*<(?:!doctype|html|head|body|title|noscript|h[1-6]|p|div)\b")
_ENTRY = re.compile(r"(?s)^(\S*?://\S+?|<%.*?%>|\{\{.*?\}\}|[$#]?\{[^{}]*\}|[^\s:]{1,200}): (.+)$")


def entry_parts(entry: str) -> tuple[str, str]:
    """What stands for the url and for the reason; an entry of another form is all reason."""
    m = _ENTRY.match(entry)
    return (m.group(1), m.group(2)) if m else ("", entry)


def entry_kind(judge: Judge, entry: str | None) -> str | None:
    if not entry or not entry.strip():
        return None
    url, reason = entry_parts(entry.strip())
    if url and not re.match(r"(?i)https?://", url) and weak(url) == PLACEHOLDER:
        return KINDS[PLACEHOLDER]
    # the text of a markup answer; a noscript element stays what it is
    text = clean(html.unescape(_TAGS.sub(" ", reason))) if "<" in reason and "<%" not in reason else reason
    # what begins as a page is the text of one, never a reason
    page = bool(_PAGE.match(reason))
    sizes: Counter[int] = Counter()
    for s in sentences(text):
        sizes[judge.kind(s, _ANSWER if page else "", page)] += len(s)
    plain = sizes.pop(CONTENT, 0)
    sizes.pop(ASIDE, None)
    # part of an answer, or a few words after it, may say nothing of themselves
    if not sizes or plain > sum(sizes.values()):
        return None
    return KINDS[max(sizes, key=lambda k: (sizes[k], -k))]


def entry_examples(entries: Iterable[str]) -> list[tuple[str, str, int]]:
    """Plain reasons as content, the rest by the labeller."""
    out: dict[tuple[str, str], int] = {}
    for e in entries:
        reason = entry_parts(e.strip())[1]
        text = clean(_TAGS.sub(" ", reason)) if "<" in reason and "<%" not in reason else reason
        parts = sentences(text)
        kinds = [weak(s) for s in parts]
        if "<" not in reason and len(parts) == 1 and _PLAIN.match(text) and kinds[0] not in {PLACEHOLDER, FILLER}:
            kinds = [CONTENT]
        title = _ANSWER if _PAGE.match(reason) else ""
        for s, k in zip(parts, _spread(kinds, parts), strict=True):
            if out.get((s, title), -1) < 0:
                out[s, title] = k
    return [(s, title, k) for (s, title), k in out.items() if k >= 0]


def train_pages(pages: list[tuple[str, list[Block], str]], reader: Reader) -> Judge:
    decoded = [(t, b, reader.labels(t, b), raw) for t, b, raw in pages]
    return fit([*page_examples(decoded), *SEEDS])


def train_crawls(entries: list[str]) -> Judge:
    return fit([*entry_examples(entries), *((s, _ANSWER, k) for s, _, k in SEEDS), *(s for s in SEEDS if not _PLAIN.match(s[0]) or s[2] in {PLACEHOLDER, FILLER})])
