"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page becomes a sequence of leaf blocks: stretches of text between block-level tags, with the open
elements above them.  Each block has features of its ancestors (tags, words of class, id and role) and of its
text (length, share of link text, punctuation, tell-tale words, place in the page).  A chain over the labels
content and boilerplate scores features and transitions.  It is trained by the gradient of the conditional
log-likelihood (forward-backward) and decoded by Viterbi.

Labelled pages: up to ``max_pages`` pages of the table of at most ``page_bytes`` each (documented bounds on training
alone) whose markup names its article;
blocks inside it, and not inside a menu, form, aside or the like, are content.  Each is also rendered anew
with its texts in other layouts, with containers that do not name the article and with notices, forms,
sidebars, adverts and reader comments, so that the chain does not hang on one tag.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, per_text

# Element classes of HTML.
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td
tfoot th thead title tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = "script|style|noscript|template|iframe|svg|canvas|object|textarea|select|title|noembed|noframes"
CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}),
          "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"optgroup"})}
NOT_CONTENT = {"nav", "aside", "footer", "form", "header", "menu", "dialog"}
TITLES = {"h1", "h2", "h3", "h4", "h5", "h6"}        # content also in the header of an article
TELLING = re.compile(r"cookie|subscri|newsletter|advert|sponsor|copyright|©|all rights|privacy|terms|login|log in|sign ?(?:in|up)|share|repl(?:y|ies)|comment|"
                     r"related|read more|menu|search|follow us|click|accept|e-?mail|password", re.IGNORECASE)

# a quote opens a value only after "="; any other ends with its tag, and an unquoted value at white space or ">"
ATTRS = r"""(?:=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)|[^>])*+"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({SKIPPED})(?=[\s/>]){ATTRS}(?<!/)>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|"
                   rf"<xmp(?=[\s/>]){ATTRS}>(?P<raw>.*?)(?:</xmp\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{ATTRS})(?:>|\Z)",
                   re.IGNORECASE | re.DOTALL)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
LABEL = re.compile(r'data-y="([01])"')
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]       # "tag word word ..." of the open elements, outermost first
    link: int                   # characters of link text
    label: int | None = None    # of a rendered training page


def leaf_blocks(page: str) -> list[Block]:
    """The non-empty leaf blocks in page order; comments, scripts, styles and other hidden content are out."""
    blocks: list[Block] = []
    stack: list[tuple[str, str]] = []
    pieces: list[str] = []
    link = links = 0
    label: int | None = None
    at = 0

    def flush() -> None:
        nonlocal link, pieces
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text:
            blocks.append(Block(text, tuple(n for _, n in stack), min(link, len(text)), label))
        pieces, link = [], 0

    def close(tag: str, bounds: Iterable[str] = ()) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                flush()
                del stack[k:]
                return
            if stack[k][0] in bounds:
                return

    for m in TOKEN.finditer(page):
        if m.start() > at:
            pieces.append(page[at:m.start()])
            if links:
                link += m.start() - at
        at = m.end()
        tag = m["tag"]
        if m["raw"] is not None:        # its text is as it stands
            flush()
            stack.append(("xmp", "xmp"))
            pieces.append(entities.escape(m["raw"]))
            flush()
            stack.pop()
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK:
                close(tag)
                links = 0 if not stack else links
            elif tag == "br":
                pieces.append(" ")
            continue
        if tag == "a":
            links += 1
        elif tag in BLOCK:
            flush()
            links = 0
            if tag in CLOSES:
                for t in CLOSES[tag][0].split():
                    close(t, CLOSES[tag][1])
            elif stack and stack[-1][0] == "p":
                stack.pop()
            if tag not in VOID and not m["attrs"].endswith("/"):
                named = tag
                if m["attrs"]:
                    words = [w.lower() for x in NAMES.findall(m["attrs"]) for w in WORDS.findall("".join(x))][:8]
                    named = " ".join([tag, *words, *["hidden!"] * bool(HIDDEN.search(m["attrs"]))])
                    if y := LABEL.search(m["attrs"]):
                        label = int(y[1])
                stack.append((tag, named))
        elif tag == "br" or tag in VOID:
            pieces.append(" ")
    if at < len(page):
        pieces.append(page[at:])
        link += (len(page) - at) * bool(links)
    flush()
    return blocks


# -- features ----------------------------------------------------------------------------------------

def path_features(path: tuple[str, ...]) -> list[str]:
    out = set()
    for element in path:
        tag, *words = element.split(" ")
        if tag not in ("html", "body"):
            out.add(f"in {tag}")
        out.update(f"named {w}" for w in words if not w.isdigit())
    tags = [element.split(" ")[0] for element in path]
    if path:
        out.add(f"tag {tags[-1]}")
    if "header" in tags:
        out.add(f"header of {'the page' if tags.index('header') == 0 or tags[tags.index('header') - 1] in ('html', 'body') else 'a part'}: {tags[-1] in TITLES}")
    if not set(tags) - {"html", "body", "p"}:
        out.add("bare")
    return sorted(out)


def text_features(b: Block, number: int, total: int) -> list[str]:
    n = b.text.count(" ") + 1
    share = b.link / max(1, len(b.text))
    told = TELLING.search(b.text) if n < 40 else None
    return [f"words {min(8, n.bit_length())}", f"link {0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}",
            f"end {b.text[-1] in '.!?:;…»”\"'}", f"place {0 if number == 0 else 4 if number == total - 1 else 1 + 3 * number // total}",
            f"long {n >= 15} {share < 0.3}", f"tell {told[0].lower()[:6]}" if told else "tell no"]


# -- the chain -----------------------------------------------------------------------------------------

@dataclass
class Chain:
    weights: dict[str, tuple[float, float]]     # per feature: boilerplate, content
    move: np.ndarray                            # 2 x 2 transitions
    ends: np.ndarray                            # first label, last label

    def __post_init__(self) -> None:
        self.paths: dict[tuple[str, ...], tuple[float, float]] = {}

    def _sum(self, features: list[str]) -> tuple[float, float]:
        found = [w for w in map(self.weights.get, features) if w]
        return sum(w[0] for w in found), sum(w[1] for w in found)

    def decode(self, blocks: list[Block]) -> list[int]:
        """Viterbi: the best label sequence (boilerplate wins ties)."""
        (a00, a01), (a10, a11) = self.move.tolist()
        back: list[tuple[int, int]] = []
        s0 = s1 = 0.0
        for i, b in enumerate(blocks):
            of_path = self.paths.get(b.path)
            if of_path is None:
                if len(self.paths) > 50_000:
                    self.paths.clear()
                of_path = self.paths[b.path] = self._sum(path_features(b.path))
            of_text = self._sum(text_features(b, i, len(blocks)))
            if i == 0:
                t0, t1 = float(self.ends[0, 0]), float(self.ends[0, 1])
            else:
                back.append((int(s1 + a10 > s0 + a00), int(s1 + a11 > s0 + a01)))
                t0, t1 = max(s0 + a00, s1 + a10), max(s0 + a01, s1 + a11)
            s0, s1 = t0 + of_path[0] + of_text[0], t1 + of_path[1] + of_text[1]
        if not blocks:
            return []
        labels = [int(s1 + float(self.ends[1, 1]) > s0 + float(self.ends[1, 0]))]
        for pointers in reversed(back):
            labels.append(pointers[labels[-1]])
        return labels[::-1]

    def extract(self, page: str) -> str:
        blocks = leaf_blocks(page)
        return "\n".join(b.text for b, y in zip(blocks, self.decode(blocks)) if y)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def gradients(emit: np.ndarray, labels: np.ndarray, move: np.ndarray, ends: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood of the labels, and its gradients by emissions, transitions and ends."""
    n = len(emit)
    ahead, behind = np.empty((n, 2)), np.empty((n, 2))
    ahead[0] = ends[0] + emit[0]
    for i in range(1, n):
        ahead[i] = _logsum(ahead[i - 1][:, None] + move, 0) + emit[i]
    behind[-1] = ends[1]
    for i in range(n - 2, -1, -1):
        behind[i] = _logsum(move + emit[i + 1] + behind[i + 1], 1)
    total = _logsum(ahead[-1] + ends[1], 0)
    single = np.exp(ahead + behind - total)
    truth = np.zeros((n, 2))
    truth[np.arange(n), labels] = 1
    pairs = np.exp(ahead[:-1, :, None] + move + (emit[1:] + behind[1:])[:, None, :] - total)
    by_move = truth[:-1].T @ truth[1:] - pairs.sum(axis=0)
    score = emit[np.arange(n), labels].sum() + move[labels[:-1], labels[1:]].sum() + ends[0, labels[0]] + ends[1, labels[-1]]
    by_ends = np.stack((truth[0] - single[0], truth[-1] - single[-1]))
    return float(score - total), truth - single, by_move, by_ends


def train(pages: list[tuple[list[Block], list[int]]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-3, seed: int = 5) -> Chain:
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    sequences = []
    for blocks, labels in pages:
        rows = [[index.setdefault(f, len(index)) for f in path_features(b.path) + text_features(b, i, len(blocks))] for i, b in enumerate(blocks)]
        if rows:
            sequences.append((rows, np.array(labels)))
    w, past = np.zeros((len(index), 2)), np.full((len(index), 2), 1e-2)
    move, ends = np.zeros((2, 2)), np.zeros((2, 2))
    past_move, past_ends = np.full((2, 2), 1e-2), np.full((2, 2), 1e-2)
    for _ in range(epochs):
        for k in rng.permutation(len(sequences)):
            rows, labels = sequences[k]
            emit = np.array([w[r].sum(axis=0) for r in rows])
            _, by_emit, by_move, by_ends = gradients(emit, labels, move, ends)
            g = np.zeros_like(w)
            flat = np.concatenate([np.array(r) for r in rows])
            np.add.at(g, flat, np.repeat(by_emit, [len(r) for r in rows], axis=0))
            for p, h, d in ((w, past, g - decay * w), (move, past_move, by_move), (ends, past_ends, by_ends)):
                h += d * d
                p += rate * d / np.sqrt(h)
    return Chain({f: (float(w[i, 0]), float(w[i, 1])) for f, i in index.items()}, move, ends)


# -- labelled pages --------------------------------------------------------------------------------------

def named_labels(blocks: list[Block]) -> list[int] | None:
    """Content is what stands in the page's article (or main) element, outside of menus, forms and so on;
    None if the page names none."""
    for holder in ("article", "main"):
        tags = [[e.split(" ")[0] for e in b.path] for b in blocks]
        if any(holder in t for t in tags):
            return [int(holder in t and not (NOT_CONTENT - ({"header"} if t[-1] in TITLES else set())) & set(t[t.index(holder):])) for t in tags]
    return None


HOLDERS = ['<article>', '<main>', '<div class="content">', '<div id="main-content">', '<div class="post-body">', '<section class="story">', '<div class="entry">',
           '<div class="article-text">', '<div>', '<td>']
SHORT = ["Home", "About us", "Contact", "News", "Sport", "Archive", "Search", "Log in", "Privacy", "Terms of use", "Share", "Next page", "Read more", "Subscribe"]


def rendered(content: list[tuple[str, str]], other: list[str], rng: random.Random) -> str:
    """A page with ``content`` (tag, text) in a random layout; leaf elements carry their label."""
    def leaf(tag: str, text: str, y: int) -> str:
        return f'<{tag} data-y="{y}">{entities.escape(text)}</{tag}>'

    def some(n: int) -> list[str]:
        return [rng.choice(other) for _ in range(n)] if other else ["Some words here."] * n

    def links(n: int) -> str:
        return "".join(f'<li data-y="0"><a href="/x">{rng.choice(SHORT)}</a></li>' for _ in range(n))
    before = [f"<header>{leaf('div', rng.choice(SHORT), 0)}{leaf('p', rng.choice(some(1)), 0)}</header>", f"<nav><ul>{links(rng.randint(3, 8))}</ul></nav>",
              f'<div class="{rng.choice(["menu", "navbar", "top-links", "breadcrumb"])}"><ul>{links(rng.randint(2, 6))}</ul></div>',
              f'<div class="{rng.choice(["cookie-notice", "notice", "alert", "consent-banner"])}">{leaf("p", rng.choice(["We use cookies to improve this site. Accept.", *some(1)]), 0)}</div>',
              f'<div class="{rng.choice(["ad", "advert", "ads banner", "sponsored", "promo"])}">{leaf("p", some(1)[0], 0)}</div>']
    after = [f'<aside class="sidebar">{leaf("h3", "Related", 0)}<ul>{links(rng.randint(2, 6))}</ul>{leaf("p", some(1)[0], 0)}</aside>',
             f'<div class="{rng.choice(["sidebar", "related", "widget", "recommended"])}">{"".join(leaf("p", t, 0) for t in some(2))}</div>',
             f'<{(c := rng.choice(["section", "div", "ol"]))} {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "reader-comments", "responses"])}">'
             + "".join(f'<div class="comment">{leaf("p", t, 0)}</div>' for t in some(rng.randint(1, 4))) + f"</{c}>",
             f'<form>{leaf("label", "Your e-mail", 0)}{leaf("p", some(1)[0], 0)}<input><button>Send</button></form>',
             f'<div class="newsletter">{leaf("p", "Subscribe to our newsletter.", 0)}</div>',
             f"<footer>{leaf('p', '© example.com · ' + some(1)[0], 0)}</footer>", f'<div id="footer">{leaf("p", "© All rights reserved", 0)}</div>']
    holder = rng.choice(HOLDERS)
    inside = [leaf(t, x, 1) for t, x in content]
    kind = rng.random()
    if kind < 0.15:             # paragraphs without a container, never closed
        bare = "".join(f'<{"p" if t not in TITLES else t} data-y="1">{entities.escape(x)}' + (f"</{t}>" if t in TITLES else "") for t, x in content)
        return f"<html><body>{''.join(rng.sample(before, rng.randint(0, 3)))}{bare}{''.join(rng.sample(after, rng.randint(0, 3)))}</body></html>"
    if kind < 0.35 and inside:  # the article has a header of its own, with its title
        title = content[0][1] if content[0][0] in TITLES else content[0][1].split(". ")[0]
        inside[0] = f"<header>{leaf('h1', title, 1)}</header>" + (inside[0] if content[0][0] not in TITLES else "")
    elif kind < 0.5 and len(content) > 2:       # a heading, and a table of sentences
        at = rng.randint(1, len(content) - 1)
        rows = "".join(f"<tr><th data-y=\"1\">{entities.escape(x.split(' ')[0])}</th><td data-y=\"1\">{entities.escape(x)}</td></tr>" for _, x in content[at:at + 3])
        inside[at:at + 3] = [leaf("h2", content[at][1].split(". ")[0][:60], 1), f"<table>{rows}</table>"]
    if rng.random() < 0.3:      # an advert amid the article
        inside.insert(rng.randint(0, len(inside)), before[4])
    body = holder + "".join(inside) + f"</{holder[1:-1].split(' ')[0]}>"
    if holder == "<td>":
        body = f"<table><tr>{body}</tr></table>"
    head, tail = rng.sample(before, rng.randint(1, 4)), rng.sample(after, rng.randint(1, 4))
    return f"<html><body>{''.join(head)}{body}{''.join(tail)}</body></html>"


def labelled_pages(pages: list[str], layouts: int = 3, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    rng = random.Random(seed)
    out, texts = [], []
    for page in pages:
        blocks = leaf_blocks(page)
        labels = named_labels(blocks)
        if labels is None:
            labels = [int(b.text.count(" ") >= 20 and b.link * 3 < len(b.text)) for b in blocks]
        elif any(labels):
            out.append((blocks, labels))
        texts.append([(b.path[-1].split(" ")[0] if b.path and b.path[-1][0] in "ph" else "p", b.text) for b, y in zip(blocks, labels) if y])
    texts = [t for t in texts if t] or [[("h1", "A title"), ("p", "Some sentences with a number of plain words, as articles have them. " * 3)]]
    pool = [x for t in texts for _, x in t[:4]]
    for content in texts:
        for _ in range(layouts):
            blocks = leaf_blocks(rendered([("p" if t not in ("p", "h1", "h2", "h3") else t, x) for t, x in content], pool, rng))
            out.append((blocks, [b.label or 0 for b in blocks]))
    return out


def training_pages(pages: DataFrame, html_col: str, max_pages: int, page_bytes: int) -> list[str]:
    """At most ``max_pages`` different pages of at most ``page_bytes``: those whose hashes are least, in that order.

    Each task hands on its least hashes, then the pages with those hashes are fetched, once each: the driver never
    sees more than the sample."""
    src = pages.select(F.col(html_col).alias("html"), F.xxhash64(html_col).alias("h")).filter(F.octet_length("html") <= page_bytes)

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(0, np.int64)
        for b in batches:
            held = np.unique(np.concatenate([held, b["h"].to_numpy(np.int64)]))[:max_pages]
        yield pd.DataFrame({"h": held})
    hashes = [r["h"] for r in src.select("h").mapInPandas(least, "h long").distinct().orderBy("h").limit(max_pages).collect()]
    if not hashes:
        return []
    chosen = src.filter((F.col("h") <= hashes[-1]) & F.col("h").isin(hashes))
    return [r["html"] for r in chosen.groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect()]


def fit(pages: DataFrame, html_col: str = "html", max_pages: int = 200, page_bytes: int = 1 << 18) -> Chain:
    """The chain from ``training_pages``."""
    return train(labelled_pages(training_pages(pages, html_col, max_pages, page_bytes)))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_pages: int = 200) -> DataFrame:
    """Per page row: id, url, text (the content blocks in page order, joined by newlines) and n_chars.

    Null and empty pages, and pages without content, have an empty text.  Whole pages are read, however long
    or broken; unclosed elements end with the page.  Repeated rows give repeated results, null ids and urls
    stay null, extra columns are ignored, and an empty table gives an empty result."""
    chain = fit(pages, html_col, max_pages)
    found = per_text(lambda c, page: (c.extract(page),), "text string", lambda: chain)
    out = pages.select(F.col(id_col).alias("id_"), F.col(url_col).alias("url_"), found(F.col(html_col)).alias("main_"))
    text = field("main_", "text")
    return out.select(F.col("id_").alias(id_col), F.col("url_").alias(url_col), text.alias("text"), F.length(text).cast("long").alias("n_chars"))
