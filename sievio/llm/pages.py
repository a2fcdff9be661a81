"""Operator 10: the main text of web pages by a maximum-scoring subsequence.

A page is a sequence of tags and runs of words. A word scores by where it stands, a tag costs by
its name. Both are log-odds counted on labelled pages (`learned`); PRIOR speaks for what these don't
show. One linear scan finds the contiguous stretch of highest score, and the words of its blocks whose
own weight is positive are the text. Names of elements, tags or parts of a class, id or role, are
features only: what is seen in labelled pages weighs as it was seen there."""

from __future__ import annotations

import html
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import basic, prepare, texts_of

#: Labelled pages that weights are counted on: the first by hash of page_id, whole.
FIT_PAGES = 1024
#: Labelled pages in which a name is seen before its own weight counts; observations that a prior is worth.
SUPPORT, PRIOR_WORDS, PRIOR_TAGS = 8, 200, 40
#: The least that one run of words can take from a stretch: an advert of any length costs an article no more than a break.
FLOOR = -6.0
_STRICT = r"""(?:[^<>"']++|"[^"<]*+(?:<(?![/A-Za-z])[^"<]*+)*+"|'[^'<]*+(?:<(?![/A-Za-z])[^'<]*+)*+')*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][\w:-]*)(?P<attr>{_STRICT})(?:>|\Z|(?=<))|<(?P<odd>/?[A-Za-z][\w:-]*)|<[!?/][^>]*(?:>|\Z)", re.S
)
#: A tag with tags in its quoted values, looked for in so many characters; else a tag ends at its first bracket.
_FULL, _FULL_MOST = re.compile(r"""(?P<attr>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>"""), 16_384
_CUT = re.compile(r"(?P<attr>[^<>]*)>?")
_NAMED = re.compile(r"""\b(?:class|id|role|aria-label|data-role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?(?:false|until))|display\s*:\s*none|\baria-hidden\s*=\s*["']?true""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Elements whose content is no text; of these, script and style last to the end of a page that doesn't close them.
_RAW = {n: re.compile(rf"</{n}\b[^>]*>", re.I) for n in "script style noscript template svg iframe object canvas audio video textarea select title xmp".split()}
_TO_END = ("script", "style")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math meter nobr q rp rt ruby s samp small span strike strong sub sup svg canvas time tt u var wbr mi mo mn mrow msup msub mfrac msqrt mtext".split())
#: Elements that hold no article text, unless labelled pages say so.
_APART = frozenset("head nav footer aside form button menu dialog fieldset datalist option input".split())
_STRUCTURE = _APART | {"header"}
_MAIN = frozenset(("article", "main"))
#: Elements that are a piece of a text: a name such as entry-title or intro-text on one says nothing about what lies around it.
_PIECES = _INLINE | frozenset("h1 h2 h3 h4 h5 h6 hgroup header p pre blockquote ul ol li dl dt dd figure figcaption address caption thead tfoot th summary legend".split())
#: Parts of a class, id or role that, where labelled pages don't show them, name something other than the article.
_NOISE = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promos promoted promotion
    banner banners cookie cookies consent gdpr notice notices notification notifications alert alerts sidebar sidebars aside rail widget
    widgets menu menus nav navbar navigation breadcrumb breadcrumbs crumbs toc share sharing social follow related recommended
    recommendations readmore trending popular comment comments commentlist disqus reply replies respond discussion footer foot colophon copyright
    header masthead topbar toolbar subscribe subscription newsletter signup login signin popup modal overlay paywall search teaser teasers
    searchbox pagination pager tags taglist contentinfo complementary form feedback outbrain taboola skip hidden""".split()
)
#: Of these, parts that also name what lies around an article: one within counts again.
_AROUND = frozenset("aside banner banners header masthead menu menus modal nav navbar navigation overlay paywall popup rail sidebar sidebars skip topbar widget widgets".split())
#: Parts that name an article.
_CONTENT = frozenset("article articlebody body content entry main post prose story text".split())
#: Weight of a word by its standing, cost of a tag: what is taken for likely before any labelled page is seen.
#: main: in an article by tag, role or name; beside: next to an article that holds most words; link; apart: in something else by tag or name.
PRIOR = {
    "main": 6.0, "plain": 1.0, "beside": -1.0, "link": -2.0, "apart": -3.11, "other": 0.5, "within": {},
    "tag": {"p": 0.1, "b": 0.1, "br": 0.13, "h1": 0.59, "div": 0.94, "a": 1.28, "li": 1.28, "article": 1.32, "ul": 1.33, "nav": 1.33, "title": 2.84, "script": 2.84, "style": 2.84, "meta": 2.84, "html": 3.0, "head": 3.0, "body": 3.0, "footer": 3.0},
}
WEIGHTS = PRIOR
_STANDINGS = ("main", "plain", "beside", "link")


class _Run:
    """Words between two tags: their block, their place in the sequence, their standing, the feature that sets them apart, their element."""

    __slots__ = ("text", "block", "at", "standing", "why", "node", "size", "article")

    def __init__(self, text, block, at, standing, why, node, article):
        self.text, self.block, self.at, self.standing, self.why, self.node, self.article = text, block, at, standing, why, node, article
        self.size = len(text.split())


def _named(attributes: str, within: dict) -> tuple[int, str, bool, tuple[str, ...]]:
    """(2 for an element apart, 1 for one that may also lie around an article, 0 else; by which name; whether it is named as an article; all names)."""
    level, why, content, seen = 0, "", False, []
    for m in _NAMED.finditer(attributes):
        for name in m[1].strip("\"'").split():
            parts = {p.lower() for p in _PART.findall(name)}
            seen += parts
            if parts & {"with", "has", "no"}:
                continue
            known = {p: within["." + p] for p in parts if "." + p in within}
            noise = {p for p in parts if known.get(p, -1 if p in _NOISE else 0) < 0}
            if noise:
                if level < 2:
                    why = "." + min(noise, key=lambda p: (known.get(p, 0), p))
                level = max(level, 1 if noise <= _AROUND and not known else 2)
            elif parts & _CONTENT or any(v > 0 for v in known.values()):
                content = True
    if _HIDDEN.search(attributes):
        level, why = 2, ".hidden"
    return level, why, content and not level, tuple("." + p for p in seen)


def _tokens(page: str) -> Iterator[tuple[int, int, str, bool, str, int]]:
    """(start, end, name, whether an end tag, attributes, end of the content that is no text) of tags and comments, in one pass."""
    at, unclosed = 0, set()
    while m := _TOKEN.search(page, at):
        start, stop = m.span()
        name, end, attr = m["name"], bool(m["end"]), m["attr"] or ""
        if m["odd"]:
            name, end = m["odd"].lstrip("/"), m["odd"][0] == "/"
            own = _FULL.match(page, stop, min(len(page), stop + _FULL_MOST)) or _CUT.match(page, stop)
            stop, attr = own.end(), own["attr"]
        name, after = (name or "").lower(), stop
        if name in _RAW and not end and name not in unclosed:
            close = _RAW[name].search(page, stop)
            if close:
                after = close.end()
            elif name in _TO_END:
                after = len(page)
            else:
                unclosed.add(name)
        yield start, stop, name, end, attr, after
        at = after


def _read(page: str, weights: dict = PRIOR, soft: bool = True) -> tuple[list[_Run], list[tuple[int, str]], list[tuple[int, tuple[str, ...]]]]:
    """The runs of words, the tags (place, name) and the elements (parent, features) of a page, in order; linear in its length.

    Without `soft`, names that may also lie around an article don't count."""
    runs: list[_Run] = []
    tags: list[tuple[int, str]] = []
    nodes: list[tuple[int, tuple[str, ...]]] = [(-1, ())]
    stack: list[tuple[str, int, int, int, str, int]] = []  # name, node, apart (as _named), main (1 by a name, 2 by tag or role), why, whether apart within an article
    opened: Counter = Counter()
    within = weights["within"]
    block = at = place = links = 0

    def text(raw: str) -> None:
        nonlocal place
        if raw:
            _, node, apart, main, why, inner = stack[-1] if stack else ("", 0, 0, 0, "", 0)
            runs.append(_Run(raw, block, place, "inner" if inner else "apart" if apart else "main" if main else "link" if links else "plain", why if apart else "", node, main == 2))
            place += 1

    def close(upto: int) -> None:
        nonlocal links
        while len(stack) > upto:
            name = stack.pop()[0]
            opened[name] -= 1
            links -= name == "a"

    for start, _, name, end, attr, after in _tokens(page):
        text(page[at:start])
        at = after
        if not name:
            continue
        place += 1
        if name in _RAW and not end:
            if not stack or not stack[-1][3] and not stack[-1][5]:
                tags.append((place - 1, name))
            block += name in ("title", "xmp")  # the others stand within a line
            continue
        if name not in _INLINE:
            block += 1
        elif name == "br":
            text(" ")
        if end:
            if not stack or not stack[-1][5]:
                tags.append((place - 1, name))
            if opened[name]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        close(i)
                        break
                    if name in _INLINE and stack[i][0] not in _INLINE:
                        break
            continue
        if name in _VOID or attr.rstrip().endswith("/") and name not in _INLINE:
            tags.append((place - 1, name))
            continue
        if name not in _INLINE:  # an open paragraph, and what is inline in it, ends where a block begins
            while stack and (stack[-1][0] in _INLINE or stack[-1][0] == "p" or stack[-1][0] == name and name in ("li", "td", "th", "tr", "dt", "dd", "option")):
                close(len(stack) - 1)
        _, up, up_apart, up_main, up_why, inner = stack[-1] if stack else ("", 0, 0, 0, "", 0)
        level, why, content, seen = _named(attr, within) if attr and name not in ("html", "body") else (0, "", False, ())
        if level == 1 and (not soft or up_main and "header" in attr.lower()):
            level = 0  # the article's own heading
        if name in _MAIN and not up_main:
            level, why = (2, why or ".teaser") if re.search(r"comment|repl(?:y|ies)|teaser|related|promo|sponsor", attr, re.I) else (0, "")
        if name in _APART and within.get(name, -1) < 0 or name in _STRUCTURE and within.get(name, 0) < 0 and not up_main:
            level, why = 2, name
        elif name == "header" and not up_main:
            level, why = max(level, 1), why or name
        as_main = name in _MAIN or re.search(r"""role\s*=\s*["']?main\b|itemprop\s*=\s*["']?articleBody""", attr) is not None
        apart = 0 if up_apart == 1 and not level and as_main else max(up_apart, level)
        inner = int(bool(inner or level and up_main))  # what is set apart within an article is no break in it
        if not inner:
            tags.append((place - 1, name))
        main = 0 if apart else max(up_main, 2 if as_main else 1 if content and name not in _PIECES else 0)
        nodes.append((up, (*seen, name) if name in _STRUCTURE else seen))
        stack.append((name, len(nodes) - 1, apart, main, why if level >= up_apart and level else up_why, inner))
        opened[name] += 1
        links += name == "a"
    text(page[at:])
    linked, words = Counter(), Counter()
    for r in runs:
        words[r.block] += r.size
        linked[r.block] += r.size * (r.standing == "link")
    for r in runs:
        if r.standing == "link" and 2 * linked[r.block] < words[r.block]:
            r.standing = "plain"  # a link within a sentence
    if 2 * sum(r.size for r in runs if r.article) >= sum(r.size for r in runs if r.standing not in ("apart", "inner")):
        for r in runs:
            if r.standing == "plain" and not r.text.isspace():
                r.standing = "beside"
    return runs, tags, nodes


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """First and last place of the contiguous stretch with the highest sum, in one pass; (0, -1) if none is positive.

    Of stretches with equal sums the one that ends first counts."""
    best, total, start, found = 0.0, 0.0, 0, (0, -1)
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i)
    return found


def _weight(run: _Run, weights: dict) -> float:
    if run.standing == "inner":
        return 0.0
    return weights["within"].get(run.why, weights["apart"]) if run.standing == "apart" else weights[run.standing]


def extract(page: str | None, weights: dict = PRIOR) -> str:
    """The main text: its blocks, white space made single, joined by line feeds."""
    if not page:
        return ""
    return _extract(page, weights) or _extract(page, weights, False)


def _extract(page: str, weights: dict, soft: bool = True) -> str:
    runs, tags, _ = _read(page, weights, soft)
    if not runs:
        return ""
    scores = [0.0] * (max(runs[-1].at, tags[-1][0] if tags else 0) + 1)
    cost, other = weights["tag"], weights["other"]
    for place, name in tags:
        scores[place] = -cost.get(name, other)
    for r in runs:
        scores[r.at] = max(FLOOR, _weight(r, weights) * r.size)
    first, last = best_stretch(scores)
    # The stretch starts and ends with blocks: none is cut within its line.
    blocks: dict[int, list[str]] = {r.block: [] for r in runs if first <= r.at <= last and r.size and _weight(r, weights) > 0}
    for r in runs:
        if r.block in blocks and _weight(r, weights) > 0:
            blocks[r.block].append(r.text)
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks.values())
    return "\n".join(line for line in lines if line)


def counted(page: str, label: str) -> Counter:
    """Observations of a labelled page: (kind, key, inside) to numbers, for words by standing and by feature, and for tags.

    The core of a page lies between the first and the last run of five words or more that stands in the
    label. A run's words are inside if they lie in the core and stand in the label."""
    runs, tags, nodes = _read(page)
    flat, out = f" {' '.join(label.split())} ", Counter()
    flats = [" ".join(html.unescape(r.text).split()) for r in runs]
    core = [r.at for r, own in zip(runs, flats) if r.size >= 5 and f" {own} " in flat]
    if not core:
        return out
    first, last = core[0], core[-1]
    inside = [[0, 0] for _ in nodes]
    for r, own in zip(runs, flats):
        if own:
            hit = first <= r.at <= last and own in flat
            out["word", "apart" if r.standing == "inner" else r.standing, hit] += r.size
            inside[r.node][hit] += r.size
    for i in range(len(nodes) - 1, 0, -1):  # an element comes after its parent
        up, features = nodes[i]
        for k in (0, 1):
            inside[up][k] += inside[i][k]
            for f in set(features) if inside[i][k] else ():
                out["within", f, bool(k)] += inside[i][k]
    for f in {f for _, features in nodes for f in features}:
        out["pages", f, True] += 1
    for place, name in tags:
        out["tag", name, first <= place <= last] += 1
    return out


def weighed(counts: Counter) -> dict:
    """Weights from observations: log-odds, drawn to the prior as by so many observations, at most 6 and at least -6."""

    def mixed(yes: int, no: int, of: float, prior: float, strength: int, to=lambda x: x) -> float:
        n = yes + no
        return round((n * to(max(-6.0, min(6.0, math.log((yes + 1) / (no + 1))))) + strength * prior) / (n + strength), 3) if n else of

    both = lambda kind, key: (counts[kind, key, True], counts[kind, key, False])
    out: dict = {k: mixed(*both("word", k), PRIOR[k], PRIOR[k], PRIOR_WORDS) for k in (*_STANDINGS, "apart")}
    seen = [f for kind, f, _ in counts if kind == "pages" and counts[kind, f, True] >= SUPPORT]
    out["within"] = {f: mixed(*both("within", f), PRIOR["apart"] if f in _STRUCTURE or f[1:] in _NOISE else 0.0, PRIOR["apart"] if f in _STRUCTURE or f[1:] in _NOISE else 0.0, PRIOR_WORDS) for f in sorted(seen) if sum(both("within", f))}
    names = {*PRIOR["tag"], *(t for kind, t, _ in counts if kind == "tag")}
    price = lambda odds: max(0.1, min(3.0, 1 - odds / 3))
    out["tag"] = {t: mixed(*both("tag", t), PRIOR["tag"].get(t, PRIOR["other"]), PRIOR["tag"].get(t, PRIOR["other"]), PRIOR_TAGS, price) for t in sorted(names)}
    return out | {"other": PRIOR["other"]}


def fit(labelled: list[tuple[str, str]]) -> dict:
    """Weights from (html, main text) pairs."""
    return weighed(sum((counted(page, label) for page, label in labelled), Counter()))


def learned(pages: DataFrame, documents: DataFrame, rows: int = FIT_PAGES) -> dict:
    """Weights counted on at most `rows` labelled pages, the first by hash of page_id, whole.

    A page's label is the text of the document whose id ends the path of its url. Pages without id,
    without such a document or with null html teach nothing; without any, the prior's weights come out.
    The counts are summed before they reach the driver, and bounded by what `rows` pages hold."""
    prepare(pages.sparkSession)
    named = basic(pages, "page_id", "url").select("page_id", F.regexp_extract("url", r"/(\d{1,18})(?:\.\w+)?/?(?:[?#].*)?$", 1).alias("_id")).filter("_id <> '' and page_id is not null")
    chosen = named.select("page_id", F.col("_id").cast("long").alias("doc_id")).orderBy(F.xxhash64("page_id"), "page_id", "doc_id").limit(rows)
    # Pairs of numbers, at most `rows`; then the texts and pages of these alone.
    labels = basic(documents, "doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("page_id").agg(F.min("text").alias("label"))
    shown = basic(pages, "page_id", "html").filter("html is not null").join(F.broadcast(chosen.select("page_id").distinct()), "page_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total.update(counted(page, label))
        keys = [json.dumps(k) for k in total]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(list(total.values()), pa.int64())], ["key", "n"])

    found = shown.join(labels, "page_id").select("html", "label").mapInArrow(count, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return weighed(Counter({tuple(json.loads(r["key"])): r["n"] for r in found}))


def main_texts(pages: DataFrame, weights: dict = PRIOR) -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    The text is '' where there is none, or the html is null or empty. A page of any length and depth is read
    whole, in time and memory linear in its length; broken markup is read as far as it goes. Of stretches with
    equal scores the one that ends first counts. Repeated rows are pages of their own with equal texts; an
    empty table gives no rows; other columns, whatever their names, are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(p, weights) for p in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    prepare(pages.sparkSession)
    return basic(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
