"""Main text of web pages as the maximum-scoring run of a page's tokens.

A page is read once into a sequence of words and tags; only what HTML itself keeps
invisible is left out. A logistic model over the elements around a place (tag names,
words of class, id and role) gives its probability p of being content. A word scores
2 p - 1, at least a trifle, so words are positive; a tag scores -price (1 - p), so
tags are negative. Elements whose tokens sum to less than zero are cut while the scan
passes them, and the contiguous run with the largest sum of what is left is the main
text. Model and price are learned from labelled pages: a set made by rule below, in
which main text is marked, and a sample of the pages at hand that name their article.
"""

from __future__ import annotations

import html as _html
import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow import small_batches

#: Distinct pages in the sample that weights are learned from: expected number, and bound (twice as many).
SAMPLE = 400
#: Score of a word that the model calls boilerplate.
TRIFLE = 1e-6
#: Every tag costs at least this part of the price.
FLOOR = 0.01

_TOKEN = re.compile(r"""<!--(.*?)(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s"']+)|([^\s=/"']+)""")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Not rendered as text by any browser that shows the page: head matter, scripts, and what embedded objects hold for others.
_INVISIBLE = set("head script style noscript template title datalist textarea iframe svg canvas object video audio math map".split())
#: Tell nothing of what is in them.
_FRAME = {"html", "body"}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SIGNED = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
#: An opening tag closes open elements of these kinds.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
_P_CLOSERS = _BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}


@dataclass
class Page:
    """``tokens``: ("o", path, 0, plain, "") opens an element, ("c", path, open token, plain, "") closes it, ("w", path, block, words, text) is text."""

    tokens: list[tuple] = field(default_factory=list)
    #: the features of the elements around a place
    paths: list[tuple[str, ...]] = field(default_factory=list)
    #: for each token whether it is main text, where the page tells (None: it does not)
    labels: list[bool | None] = field(default_factory=list)
    blocks: int = 0


def _told(attributes: str) -> tuple[bool, list[str]]:
    """Whether an element is hidden, and the words of its class, id and role."""
    words: list[str] = []
    if "=" not in attributes and "hidden" not in attributes:
        return False, words
    for name, value, bare in _ATTRIBUTE.findall(attributes):
        name = (name or bare).lower()
        value = value.strip("\"'")
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, words
        if name == "role":
            words.append("@" + value.lower())
        elif name in ("class", "id"):
            words += ["." + w.lower().rstrip("s") for w in _WORD.findall(value)]
    return False, words


def read(page: str | None) -> Page:
    """Words and tags of a page. Labels come from the comments ``main`` and ``/main``, or from article and main elements."""
    out, numbers = Page(), {}
    # tag, hidden from here on, path, open token, whether the element has features of its own, whether it is in a main element, or aside in one
    stack: list[tuple] = []
    at, source, marked, named, empty = 0, page or "", False, False, True
    marks = "<!--main-->" in source

    def number(path: tuple[str, ...]) -> int:
        if path not in numbers:
            numbers[path] = len(out.paths)
            out.paths.append(path)
        return numbers[path]

    def top() -> tuple:
        return stack[-1] if stack else ("", False, (), -1, False, 0)

    def say(text: str) -> None:
        nonlocal empty
        if not text or empty and text.isspace():
            return
        text, path = _html.unescape(text), top()[2]
        n = len(text.split())
        if n and empty and _SIGNED.match(text.lstrip()) and n <= 12:
            path = (*path, "#signed")
        empty = empty and not n
        out.tokens.append(("w", number(path), out.blocks, n, text))
        out.labels.append(marked if marks else (None, False, True)[top()[5]] if stack and top()[5] else None)

    def flush() -> None:
        nonlocal empty
        if not empty:
            out.blocks += 1
            empty = True

    def pop_to(k: int) -> None:
        while len(stack) > k:
            tag, hidden, path, opened, plain, _ = stack[-1]
            if tag in _BLOCKS and not hidden:
                flush()
            stack.pop()
            if not hidden and opened >= 0:
                out.tokens.append(("c", number(path), opened, plain, ""))
                out.labels.append(None)

    while at < len(source):
        m = _TOKEN.search(source, at)
        if not top()[1]:
            say(source[at : m.start() if m else len(source)])
        if not m:
            break
        at = m.end()
        if m[1] in ("main", "/main"):
            flush()
            marked = m[1] == "main"
        closing, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if k is not None and not any(stack[i][0] in _BLOCKS and stack[i][0] != "p" for i in range(k + 1, len(stack)) if tag not in _BLOCKS):
                if tag in _BLOCKS or k == len(stack) - 1:
                    pop_to(k)
                else:
                    del stack[k]  # a crossing inline element
            continue
        if tag in _P_CLOSERS:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p" or stack[i][0] in _P_CLOSERS), None)
            if k is not None and stack[k][0] == "p":
                pop_to(k)
        if tag in _CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in _HOLDS[tag]:
                    break
                if stack[i][0] in _CLOSES[tag]:
                    pop_to(i)
        _, hidden, path, _, _, place = top()
        if tag in _VOID:
            if not hidden:
                if tag == "br":
                    say(" ")
                elif tag == "hr":
                    flush()
                out.tokens.append(("o", number(path), 0, True, ""))
                out.labels.append(None)
            continue
        if attributes.endswith("/") and tag in ("path", "g", "rect", "circle"):
            continue
        gone, words = _told(attributes) if attributes else (False, [])
        if not hidden and tag in _BLOCKS:
            flush()
        hidden = hidden or gone or tag in _INVISIBLE
        if not hidden:
            # a tag counts once however often it nests, a word of a class up to three times
            more = [] if tag in _FRAME or tag in path else [tag]
            more += [w for w in dict.fromkeys(words) if path.count(w) < 3]
            path = tuple(sorted((*path, *more)))
            if tag in ("article", "main") and not marks:
                named, place = True, place or 2
            elif place == 2 and tag in ("aside", "nav", "footer", "form", "section", "header"):
                place = 0  # may or may not be part of the article
            out.tokens.append(("o", number(path), 0, tag not in _BLOCKS and not words, ""))
            out.labels.append(None)
        if tag in _RAW:
            end = re.compile(f"</{tag}[\\s/>]", re.I).search(source, at)
            if end is None:
                break
            at = source.find(">", end.start())
            at = len(source) if at < 0 else at + 1
            continue
        stack.append((tag, hidden, path, len(out.tokens) - 1 if not hidden else -1, tag not in _BLOCKS and not words, place))
    pop_to(0)
    if named:  # what stands in no article at all is not main text
        depth = 0
        for i, (kind, path, *_) in enumerate(out.tokens):
            if kind == "w" and out.labels[i] is None:
                held = {"article", "main"} & set(out.paths[path])
                out.labels[i] = None if held else False
    return out


@dataclass
class Weights:
    """``by``: weights of features; ``bias``; ``price`` of a tag that is surely not content."""

    by: dict[str, float]
    bias: float
    price: float

    def probability(self, path: tuple[str, ...]) -> float:
        z = self.bias + sum(self.by.get(f, 0.0) for f in path)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

    def scores(self, page: Page) -> tuple[list[float], list[float]]:
        """The score of a word and of a tag at each path."""
        p = [self.probability(x) for x in page.paths]
        return [max(TRIFLE, 2 * x - 1) for x in p], [-self.price * max(FLOOR, 1 - x) for x in p]


def best_run(scores: list[float]) -> tuple[int, int] | None:
    """First and last place of the contiguous run with the largest sum, the first one of equals; None if no sum is above 0."""
    top, total, first, best = 0.0, 0.0, 0, None
    for i, x in enumerate(scores):
        if total <= 0:
            total, first = 0.0, i
        total += x
        if total > top:
            top, best = total, (first, i)
    return best


def run_of(page: Page, weights: Weights) -> list[int]:
    """The text tokens of the main text: negative elements cut, then the best run, grown to whole blocks."""
    word, tag = weights.scores(page)
    left: list[int] = []
    score: list[float] = []
    opened: dict[int, tuple[int, float]] = {}
    total = 0.0
    for i, (kind, path, ref, n, _) in enumerate(page.tokens):
        if kind == "o":
            opened[i] = (len(left), total)
        x = word[path] * n if kind == "w" else tag[path]
        total += x
        left.append(i)
        score.append(x)
        if kind == "c":
            start, before = opened.pop(ref)
            # an inline element without a class is part of its sentence
            if total < before and not n:
                del left[start:], score[start:]
                total = before
    run = best_run(score)
    if run is None:
        return []
    kept = [i for i in left if page.tokens[i][0] == "w"]
    inside = [page.tokens[i][2] for i in left[run[0] : run[1] + 1] if page.tokens[i][0] == "w" and page.tokens[i][3]]
    return [i for i in kept if inside[0] <= page.tokens[i][2] <= inside[-1]] if inside else []


def extract(page: str | None, weights: Weights) -> str:
    """Main text: white space within a block is one space, blocks are joined by an empty line."""
    got = read(page)
    blocks: dict[int, list[str]] = defaultdict(list)
    for i in run_of(got, weights):
        blocks[got.tokens[i][2]].append(got.tokens[i][4])
    texts = [" ".join("".join(x).split()) for _, x in sorted(blocks.items())]
    return "\n\n".join(x for x in texts if x)


#: Parts of labelled pages. Content, in the elements that hold it; the copyright sentence shows that articles may begin so.
_CONTENT = [
    "<h1>Title of it</h1><p>Some words of the <b>main</b> text <a href=x>with a link</a> in it.</p><p>More of it.</p>", "<h1 class=title>Name</h1><h2>Part</h2><p class=lead>First words.</p><p><em>Then</em> <a href=x>more</a>.</p>",
    "<header><h1>Copyright law today</h1></header><p>Text.</p><ul><li>one point</li><li>a second <a href=x>point</a></li></ul>", "<h3>Steps</h3><ol><li><p>do this</p></li><li>then that</li></ol><p>Done.</p>", "<h2>Data</h2><table><tr><th>a</th><td>1</td></tr><tr><td>b</td><td>2</td></tr></table><p>See above.</p>",
    "<p>He said</p><blockquote><p>words of another</p></blockquote><pre>x = 1</pre><dl><dt>term</dt><dd>meaning</dd></dl>", "<figure><img src=x><figcaption>what it shows</figcaption></figure><p>A text <span>goes</span> on <code>here</code>.</p><h4>Last</h4><p>End.</p>", "<section><h2>One</h2><p>text of it</p></section><section><h2>Two</h2><p>text of that</p></section>",
]
_PLAIN = ["plain words without any tag", "<p>one paragraph</p><p>another one</p>", "<h1>Head</h1><p>one <a href=x>two</a> three</p><p>four</p>", "<div><h1>Head</h1><p>one two</p><p>three</p></div>", "<div><div><p>one two three</p><h2>four</h2><p>five</p></div></div>", "<section><h1>a</h1><p>b c</p></section>"]
#: Frames around content; %s is the content.
_FRAMES = ["<article>%s</article>", "<main>%s</main>", "<main><article class=post>%s</article></main>", "<div class=content>%s</div>", "<div id=main-content><div class=entry>%s</div></div>", "<div class='page has-%s'>%%s</div>", "<div class='container with-%s'><section>%%s</section></div>", "<div id=wrapper class='layout no-%s'>%%s</div>", "<div class='page layout container'><div class='body article text'>%s</div></div>", "<div><div>%s</div></div>", "%s"]
#: Boilerplate elements whose tag tells, and roles.
_TAGS = ["nav", "aside", "footer", "form", "dialog"]
_ROLES = ["navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu"]
#: Words by which pages name their boilerplate (singular).
_NAMES = "ad advert advertisement adsense sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb cookie notice consent gdpr popup modal overlay newsletter subscribe subscription signup login comment commentlist disqus reply respond share sharing social related recommended footer header masthead topbar toolbar pagination pager widget skip disclaimer".split()
#: What stands in boilerplate; some of it looks like content.
_FILL = ["Home", "<ul><li><a href=x>Home</a></li><li><a href=x>About us</a></li></ul>", "<p>Some words of it.</p><p>And more <a href=x>of it</a>.</p>", "<h3>More</h3><div>buy now</div>", "<label>Name <input></label><button>Send</button>", "<ol><li><p>I think so too</p></li></ol>", "<select><option>one</option></select><span>pick</span>", "<a href=x>Link</a> <a href=y>Link</a>"]
#: Boilerplate without any name.
_BARE = ["<div><ul><li><a href=x>Home</a></li><li><a href=x>News</a></li></ul></div>", "<div>Copyright 2020 by us</div>", "<p>© us</p>", "<header><p>Site name</p><a href=x>Home</a></header>", "<div><a href=x>Home</a> | <a href=x>Imprint</a></div>", "<ul><li>Home</li><li>About</li></ul>", "<center>Welcome, guest</center>", "<div>buy now</div>", "<button>Send</button>", "<select><option>one</option></select>", "<table><tr><td><a href=x>Home</a></td></tr></table>"]


def labelled_pages() -> list[str]:
    """Pages with the main text between comments, one for each boilerplate element and frame."""
    bad = [f"<{t}>{{}}</{t}>" for t in _TAGS] + [f"<div role={r}>{{}}</div>" for r in _ROLES]
    bad += [f"<{t} {a}={n}>{{}}</{t}>" for k, n in enumerate(_NAMES) for t, a in [("div", "class"), (("section", "ul", "p", "span")[k % 4], ("id", "class")[k % 2])]]
    # text without any frame is content unless something speaks against it
    out, k = [f"<!--main-->{x}<!--/main-->" for x in _PLAIN for _ in bad], 0
    for element in bad:
        for frame in _FRAMES:
            name = _NAMES[k % len(_NAMES)]
            frame = frame % name if "%%s" in frame else frame
            one, two, three = (element.format(_FILL[(k + j) % len(_FILL)]) for j in range(3))
            content, bare = _CONTENT[k % len(_CONTENT)], _BARE[k % len(_BARE)]
            # boilerplate before, within and after the content
            inner = f"<!--main-->{content}<!--/main-->{two}<!--main--><p>It goes on.</p><!--/main-->"
            own = f"<header><!--main--><h1>Head</h1><!--/main--></header>{inner}" if k % 3 == 0 else inner
            out.append(f"<html><body>{bare if k % 2 else one}{frame % own}{three if k % 2 else bare}</body></html>")
            k += 1
    return out


def _learn_weights(pages: list[tuple[Page, float]], rounds: int = 1500, l2: float = 2e-4) -> tuple[dict[str, float], float]:
    """Logistic regression over paths; main text and the rest of a page have the same say."""
    seen: dict[tuple[str, ...], list[float]] = defaultdict(lambda: [0.0, 0.0])
    for page, weight in pages:
        sums = [0.0, 0.0]
        for (kind, _, _, n, _), label in zip(page.tokens, page.labels, strict=True):
            if kind == "w" and label is not None:
                sums[label] += n
        for (kind, path, _, n, _), label in zip(page.tokens, page.labels, strict=True):
            if kind == "w" and label is not None and n:
                seen[page.paths[path]][label] += weight * n / sums[label]
    features = {f: i for i, f in enumerate(sorted({f for path in seen for f in path}))}
    pairs = np.array([(r, features[f]) for r, path in enumerate(seen) for f in path], dtype="int64").reshape(-1, 2)
    row, col, n = pairs[:, 0], pairs[:, 1], len(seen)
    out, good = np.array(list(seen.values())).T
    total = max((out + good).sum(), 1e-9)
    w, bias, second, second_bias = np.zeros(len(features)), 0.0, np.full(len(features), 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(row, w[col], n) + bias
        gap = ((out + good) / (1 + np.exp(-np.clip(z, -60, 60))) - good) / total
        g = np.bincount(col, gap[row], len(features)) + l2 * w / max(1, len(features))
        second += g * g
        second_bias += gap.sum() ** 2
        w -= 1.5 * g / np.sqrt(second)
        bias -= 1.5 * gap.sum() / math.sqrt(second_bias)
    return {f: round(float(w[i]), 4) for f, i in features.items()}, round(float(bias), 4)


def fit(pages: list[Page]) -> Weights:
    """Weights from the pages made by rule and, with the same say in all, from ``pages`` that name their main text.

    The price is the one at which the extracted words agree best (F1, on average over
    pages) with the labels; of equally good ones the middle one.
    """
    made = [read(x) for x in labelled_pages()]
    own = [p for p in pages if any(x for x in p.labels)]
    weighted = [(p, 1 / len(made)) for p in made] + [(p, 1 / len(own)) for p in own]
    by, bias = _learn_weights(weighted)
    found = []
    for price in (0.1, 0.25, 0.5, 1.0, 2.0, 3.0, 4.0, 6.0, 8.0):
        weights, score = Weights(by, bias, price), 0.0
        for page, share in weighted:
            took = {i for i in run_of(page, weights) if page.labels[i] is not None}
            hit = sum(page.tokens[i][3] for i in took if page.labels[i])
            size = sum(page.tokens[i][3] for i in took) + sum(t[3] for t, x in zip(page.tokens, page.labels, strict=True) if t[0] == "w" and x)
            score += share * (2 * hit / size if size else 1.0)
        found.append((round(score, 9), price))
    best = [price for score, price in found if score == max(found)[0]]
    return Weights(by, bias, best[len(best) // 2])


def learn(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> Weights:
    """Fit on ``sample`` distinct pages on average, at most twice as many, of those that have an article or main element.

    They are chosen by a hash of the page: null pages are never chosen, and repeated
    ones once. Without any such page the pages made by rule remain.
    """
    small_batches(pages.sparkSession)
    html = F.col(html_col)
    named = pages.select(html.alias("html"), F.xxhash64(html).alias("h")).where(html.isNotNull() & F.lower(html).rlike("<(article|main)[\\s>]"))
    total = named.agg(F.approx_count_distinct("h", 0.02)).first()[0] or 0
    some = named.where(F.pmod("h", F.lit(1 << 30)) < float(1 << 30) * min(1.0, sample / max(1, total)))
    # repeats meet map-side; the limit orders by the hash, so it is no matter of luck which pages it leaves
    some = some.groupBy("h").agg(F.min("html").alias("html")).orderBy("h").limit(2 * sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [read(x) for batch in batches for x in batch["html"]]
        for page in got:  # the texts are not needed any more
            page.tokens = [(*t[:4], "") for t in page.tokens]
        yield pd.DataFrame({"weights": [json.dumps(vars(fit(got)))]})

    row = some.repartition(1).mapInPandas(run, "weights string").first()
    return Weights(**json.loads(row["weights"])) if row else fit([])


def main_text(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row; a null page and one without words give the empty text.

    Repeated rows give repeated results. Null ids and urls are kept; other columns are ignored.
    """
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            yield pd.Series([extract(x, weights) for x in some], dtype="object")

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), run(F.col(html_col)).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
