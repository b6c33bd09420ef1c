"""Main text of web pages by a tree-structured graphical model.

Every block element of the DOM is a binary variable: content or not. Its own
features (tag, names in class, id and role, text and link statistics) give its
unary potential, and each parent-child edge a 2 x 2 potential that favours
equal labels. The tree has no cycles, so sum-product messages, upward from the
leaves and downward from the root, give exact marginals; a block's text is kept
when its node's marginal is at least a half.

Unary weights and edge potentials are trained together, by maximum likelihood, on
labelled pages. They are generated by rule
(``labelled_page``): layouts with and without landmark elements, menus,
sidebars, notices, adverts, forms, comments, lists, tables, unclosed tags; a
mark on each part says which it is. Messages run level by level over all pages
of a part at once, in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import slices, utf8
from basketry.llm.dom import Node, parse

TAGS = ["p", "h", "li", "list", "table", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form",
        "quote", "figure", "other"]
_TAG_OF = {**{f"h{i}": "h" for i in range(1, 7)}, "ul": "list", "ol": "list", "dl": "list", "menu": "nav", "dt": "li", "dd": "li",
           "table": "table", "tbody": "table", "thead": "table", "tr": "table", "td": "table", "th": "table",
           "blockquote": "quote", "pre": "quote", "fieldset": "form", "figcaption": "figure", "hgroup": "h"}
GOOD = frozenset("article content post story entry text prose body main page".split())
BAD = frozenset(
    "nav menu sidebar foot footer header masthead ad ads advert advertisement adsense sponsor sponsored promo banner cookie "
    "cookies consent gdpr notice alert popup modal overlay share social related recommended recommendations widget breadcrumb "
    "breadcrumbs pagination pager subscribe newsletter signup login search copyright legal toolbar teaser trending navigation "
    "contentinfo complementary tags meta byline form skip dialog".split())
TALK = frozenset("comment comments reply replies discussion respond disqus thread feedback".split())
N_FEATURES = len(TAGS) + 17


def features(nodes: list[Node], blocks: list[tuple[int, str]]) -> np.ndarray:
    n = len(nodes)
    own = np.array([x.text for x in nodes], float)
    link = np.array([x.links for x in nodes], float)
    ends, words = np.zeros(n), np.zeros(n)
    sign = np.zeros(n)
    for at, text in blocks:
        ends[at] += text.count(". ") + text.count("! ") + text.count("? ") + (text[-1] in ".!?:;\"")
        words[at] += text.count(" ") + 1
        sign[at] += "©" in text or "(c)" in text
    sub, sub_link, sub_ends = own.copy(), link.copy(), ends.copy()
    kids = np.zeros(n)
    f = np.zeros((n, N_FEATURES))
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        sub[p] += sub[i]
        sub_link[p] += sub_link[i]
        sub_ends[p] += sub_ends[i]
        kids[p] += 1
    total = max(1.0, sub[0])
    for i, x in enumerate(nodes):
        tag = _TAG_OF.get(x.tag, x.tag)
        f[i, TAGS.index(tag) if tag in TAGS else -1 - 17] = 1
        if x.names:
            names = set(x.names)
            f[i, -17], f[i, -16], f[i, -15] = bool(names & GOOD), bool(names & BAD), bool(names & TALK)
    k = len(TAGS) + 3
    f[:, k] = np.log1p(own) / 5
    f[:, k + 1] = np.log1p(sub) / 8
    f[:, k + 2] = sub / total
    f[:, k + 3] = sub_link / np.maximum(1, sub)
    f[:, k + 4] = np.log1p(sub_ends) / 3
    f[:, k + 5] = (own > 0) & (ends == 0)
    f[:, k + 6] = np.log1p(words) / 5
    f[:, k + 7] = sign > 0
    f[:, k + 8] = np.minimum(1, np.array([x.depth for x in nodes]) / 10)
    f[:, k + 9] = np.log1p(kids) / 4
    f[:, k + 10] = sub == 0
    f[:, k + 11] = own > 80
    f[:, k + 12] = (link > 0.5 * own) & (own > 0)
    f[:, k + 13] = 1
    return f


def beliefs(score: np.ndarray, parent: np.ndarray, depth: np.ndarray, edge: np.ndarray):
    """Sum-product on a forest. ``score``: unary log odds; ``parent``: -1 at
    roots; ``edge``: log potentials by (parent label, child label). Returns the
    content marginals of the nodes, and per node the joint marginals of its
    parent's label and its own (zeros at roots)."""
    inward = np.stack([np.zeros(len(score)), score], 1)  # unary and messages from children
    upward = np.zeros_like(inward)                       # message of a node to its parent
    pair = np.zeros((len(score), 2, 2))
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)]
    for at in reversed(levels[1:]):
        upward[at] = np.logaddexp(edge[:, 0] + inward[at, :1], edge[:, 1] + inward[at, 1:])
        upward[at] -= upward[at].max(1, keepdims=True)
        np.add.at(inward, parent[at], upward[at])
    full = inward.copy()
    for at in levels[1:]:
        out = full[parent[at]] - upward[at]  # parent without this child
        joint = out[:, :, None] + edge + inward[at][:, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        pair[at] = joint / joint.sum((1, 2), keepdims=True)
        down = np.logaddexp(edge[0] + out[:, :1], edge[1] + out[:, 1:])
        full[at] = inward[at] + down - down.max(1, keepdims=True)
    return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -500, 500))), pair


def marginals(score: np.ndarray, parent: np.ndarray, depth: np.ndarray, edge: np.ndarray) -> np.ndarray:
    return beliefs(score, parent, depth, edge)[0]


# -- training ---------------------------------------------------------------

def labelled_page(rng: np.random.Generator) -> str:
    """A page whose parts carry ``data-y``: 1 for main text, 0 for the rest."""
    syllables = "ka lo mi tre sun ver at en on ing ti sha re or ou de la ch ie mo".split()

    def r(n):
        return int(rng.integers(n))

    # Pages differ in style: plain prose, prose without stops, symbols after
    # words, one word over and over, capitals.
    style = ["plain"] * 5 + ["bare", "symbols", "same", "capitals"]
    style = style[r(len(style))]
    always = "".join(syllables[r(20)] for _ in range(2))

    def word():
        w = always if style == "same" else "".join(syllables[r(20)] for _ in range(1 + r(3)))
        return w + ("", "%%%", "&amp;&amp;&amp;", "***", " |")[r(5)] if style == "symbols" else w

    def sentence(n=12):
        s = " ".join(word() for _ in range(1 + r(n)))
        return {"bare": s, "same": s, "capitals": s.upper() + "!!"}.get(style, s.capitalize() + ".")

    def para(n=5):
        return " ".join(sentence() for _ in range(1 + r(n)))

    def pick(*xs):
        return xs[r(len(xs))]

    def some(p, x):
        return x() if rng.random() < p else ""

    def links(n):
        return "<ul>" + "".join(f'<li><a href="/{word()}">{word()}</a>{pick("</li>", "")}' for _ in range(2 + r(n))) + "</ul>"

    def main_part():
        out = [some(0.8, lambda: f"<h1>{sentence(8)}</h1>")]
        for _ in range(1 + r(12)):
            out.append(pick(
                *[lambda: f"<p>{para()}</p>"] * 6, lambda: f"<p>{para()}", lambda: f"<p>{sentence(2)}</p>",
                lambda: f"<p><b>{sentence()}<br><p>{para()}</p>", lambda: f"<h2>{sentence(5)[:-1]}</h2>",
                lambda: f'<p>{sentence()} <a href="/x">{word()}</a> {para()}</p>',
                lambda: "<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(1 + r(5))) + "</ul>",
                lambda: f"<blockquote><p>{para(2)}</p></blockquote>", lambda: f"<div>{para(3)}</div>",
                lambda: f"<table><tr><td>{word()}</td><td>{sentence(4)}</td></tr></table>",
                lambda: f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>",
                lambda: f'<div class="{pick("ad", "advert", "share", "related")}" data-y="0">{sentence()}</div>')())
        body = "".join(out)
        return pick(lambda: f'<article data-y="1">{body}</article>', lambda: f'<main data-y="1">{body}</main>',
                    lambda: f'<article class="{pick("post", "story", "entry")}" data-y="1">{body}</article>',
                    lambda: f'<div class="{pick("content", "post-body", "entry-content", "story", "article")}" data-y="1">{body}</div>',
                    lambda: f'<div id="{pick("main", "content", "c1", "wrap")}" data-y="1">{body}</div>',
                    lambda: f'<section data-y="1">{body}</section>')()

    top = [lambda: f'<nav data-y="0">{links(8)}</nav>', lambda: f'<header data-y="0"><div>{word()}</div>{links(5)}</header>',
           lambda: f'<div class="{pick("menu", "navbar nav", "breadcrumbs")}" data-y="0">{links(6)}</div>',
           lambda: f'<div class="{pick("ad", "ads", "banner", "sponsored", "promo")}" data-y="0">{para(2)}</div>',
           lambda: f'<div id="{pick("cookie-notice", "consent", "notice")}" data-y="0"><p>{para(2)}</p><button>{word()}</button></div>',
           lambda: f'<header data-y="0"><p>{sentence()}</p></header>', lambda: f'<div data-y="0">{links(9)}</div>']
    bottom = [lambda: f'<footer data-y="0">&copy; {word()}.example.com &middot; {para(2)}</footer>',
              lambda: f'<aside data-y="0"><h3>{sentence(3)}</h3><p>{sentence()}</p>{links(5)}</aside>',
              lambda: f'<div class="sidebar" data-y="0"><h4>{word()}</h4>{links(6)}<p>{para(2)}</p></div>',
              lambda: f'<form data-y="0"><p>{sentence()}</p><label>{word()}</label><input></form>',
              lambda: f'<section class="{pick("comments", "discussion", "comment-list")}" data-y="0"><h3>{sentence(3)}</h3>'
                      + "".join(f'<div class="comment"><p>{para(3)}</p></div>' for _ in range(1 + r(4))) + "</section>",
              lambda: f'<div id="comments" data-y="0">' + "".join(f"<p>{para(3)}</p>" for _ in range(1 + r(4))) + "</div>",
              lambda: f'<footer data-y="0"><p>{para(2)}</p>{links(4)}</footer>',
              lambda: f'<div class="related" data-y="0"><h3>{word()}</h3>{links(5)}</div>']
    above = "".join(some(0.6, t) for t in rng.permutation(np.array(top, object))[:4])
    below = "".join(some(0.6, t) for t in rng.permutation(np.array(bottom, object))[:5])
    inside = above + main_part() + below
    return "<html><head><title>t</title></head><body>" + pick(inside, f"<div>{inside}</div>", f'<div class="page">{inside}</div>') + "</body></html>"


def node_labels(nodes: list[Node]) -> np.ndarray:
    """1, 0, or -1 for nodes above the marked parts."""
    y = np.full(len(nodes), -1)
    for i, x in enumerate(nodes):
        y[i] = int(x.mark) if x.mark is not None else (y[x.parent] if i else -1)
    return y


def _forest(trees: list[tuple[list[Node], list]]):
    """First node of each tree, parents and depths of all nodes, features."""
    first = np.cumsum([0] + [len(nodes) for nodes, _ in trees])
    parent = np.concatenate([[x.parent + (a if x.parent >= 0 else 0) for x in nodes] for a, (nodes, _) in zip(first, trees)])
    depth = np.concatenate([[x.depth for x in nodes] for nodes, _ in trees])
    return first, parent, depth, np.concatenate([features(*t) for t in trees])


def train(seed: int = 3, pages: int = 500, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Unary weights and edge log potentials of greatest likelihood. The model
    is a tree, so its expected statistics, and with them the gradient, are
    exact: observed less expected features and label pairs. Nodes above the
    marked parts hold no text of their own; they count as no content."""
    rng = np.random.default_rng(seed)
    trees = [parse(labelled_page(rng)) for _ in range(pages)]
    y = np.concatenate([np.maximum(node_labels(nodes), 0) for nodes, _ in trees])
    _, parent, depth, x = _forest(trees)
    child = np.flatnonzero(parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[parent[child]], y[child]), 1.0)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        p, pair = beliefs(x @ theta[:-4], parent, depth, theta[-4:].reshape(2, 2))
        grad = np.concatenate([x.T @ (y - p), (seen - pair.sum(0)).ravel()]) / len(y) - 1e-4 * theta
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        theta += 0.15 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    return theta[:-4], theta[-4:].reshape(2, 2)


def main_texts(pages: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    w, edge = model
    trees = [parse(p) for p in pages]
    if not trees:
        return []
    first, parent, depth, x = _forest(trees)
    score = x @ w
    keep = marginals(score, parent, depth, edge) >= 0.5
    return ["\n".join(t for at, t in blocks if keep[a + at]) for a, (_, blocks) in zip(first, trees)]


def _extract(model):
    def run(batches):
        for part in slices(batches, rows=300):
            texts = main_texts(part.column(0).to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*part.schema.names[1:], "text", "n_chars"])
    return run


def extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text, n_chars``.

    ``text`` holds the blocks of main text in page order, joined by newlines;
    inside a block, references are decoded and white space is one space. Null,
    empty and text-free pages give an empty text. Repeated rows count each. Other
    columns of ``pages``, whatever their names, play no part.
    """
    rows = pages.select(F.coalesce("html", F.lit("")).alias("html"), "page_id", "url")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(_extract(model or train()), f"{schema}, text string, n_chars long")
