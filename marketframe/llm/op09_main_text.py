"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

Each block of a page is labelled main or not.  Features of a block: the tags above it, the nearest of them that
divide a page, the names (class, id, role) above it, its length, its share of link text, its punctuation.  The field is
trained by gradient ascent on the regularised likelihood of labelled pages and decoded by Viterbi.

The labelled pages are made by ``labelled_pages``: ``TRAIN_PAGES`` pages of many layouts, from a seed, with every
block's label known; a caller may pass pages of its own.  The fit is bounded by their number.  Every page is
decoded whole.

Defined cases: null or empty html gives an empty text and 0 characters; so does a page without main blocks; broken
markup is read tolerantly, in time linear in its length however deep it nests; hidden blocks are no main text; rows that repeat a page_id each get a row; columns besides ``html`` are carried along.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm import words
from marketframe.llm.html_blocks import Block, Element, leaf_blocks

TRAIN_PAGES = 600
ROUNDS = 150

# Names that pages give to their parts.
MAIN_NAMES = "article post entry content story body text main page blog news detail".split()
OTHER_NAMES = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs pagination pager tabs toc".split(),
    "header": "header masthead topbar banner logo branding".split(),
    "footer": "footer copyright legal bottom colophon imprint".split(),
    "sidebar": "sidebar related recommended widget aside rail popular trending".split(),
    "notice": "cookie cookies consent notice gdpr popup modal alert newsletter subscribe signup paywall".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo adsense promoted".split(),
    "comments": "comment comments respond reply replies disqus discussion reactions".split(),
    "share": "share social sharing follow".split(),
}


def around(element: Element | None) -> list[str]:
    """Tags and names of an element and those around it, each once."""
    out = []
    while element is not None:
        out += element.new
        element = element.parent
    return out


def own_features(block: Block) -> list[str]:
    """Features of a block but its ``around``."""
    element = block.element
    out = ["bias", f"tag {element.tag if element else ''}", f"part {element.part if element else ''}", *(f"inner {n}" for n in (element.inner if element else ()))]
    n = len(block.text.split())
    out.append(f"words {min(n.bit_length(), 7)}")
    out.append(f"links {min(4, 5 * block.link_chars // max(1, len(block.text)))}")
    if re.search(r"[.!?…。！？:;][\"'”’)\]]*$", block.text):
        out.append("sentence")
    if "©" in block.text:
        out.append("sign")
    return out


def features(block: Block) -> list[str]:
    return own_features(block) + around(block.element)


class Field:
    """Weights (feature, label) and (label, label) of the chain; label 1 is main text."""

    def __init__(self, names: list[str], emit: np.ndarray, move: np.ndarray, first: np.ndarray):
        self.emit = {n: (float(a), float(b)) for n, (a, b) in zip(names, emit)}
        self.move, self.first = move.tolist(), first.tolist()

    def _sum(self, found) -> tuple[float, float]:
        weights = [self.emit[f] for f in found if f in self.emit]
        return sum(a for a, _ in weights), sum(b for _, b in weights)

    def _around(self, element: Element | None) -> tuple[float, float]:
        """The weights of ``around``, which each element of a page remembers: the work grows with the elements, not their depth."""
        waiting = []
        while element is not None and (element.score is None or element.score[0] is not self):
            waiting.append(element)
            element = element.parent
        a, b = element.score[1] if element is not None else (0.0, 0.0)
        for element in reversed(waiting):
            x, y = self._sum(element.new)
            a, b = a + x, b + y
            element.score = (self, (a, b))
        return a, b

    def scores(self, block: Block) -> tuple[float, float]:
        (a, b), (x, y) = self._sum(own_features(block)), self._around(block.element)
        return a + x, b + y

    def decode(self, blocks: list[Block]) -> list[int]:
        """The most likely labels (Viterbi)."""
        if not blocks:
            return []
        (a, b), move, back = self.scores(blocks[0]), self.move, []
        a, b = a + self.first[0], b + self.first[1]
        for block in blocks[1:]:
            x, y = self.scores(block)
            from_a, from_b = (a + move[0][0], b + move[1][0]), (a + move[0][1], b + move[1][1])
            back.append((int(from_a[1] > from_a[0]), int(from_b[1] > from_b[0])))
            a, b = x + max(from_a), y + max(from_b)
        labels = [int(b > a)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def fit(pages: list[tuple[list[Block], list[int]]], rounds: int = ROUNDS, penalty: float = 0.02, rate: float = 0.1) -> Field:
    """Maximum likelihood with a squared penalty, by Adam; all pages step through the chain together."""
    pages = [p for p in pages if p[0]]
    each = [[features(b) for b in blocks] for blocks, _ in pages]
    names = sorted({f for page in each for fs in page for f in fs})
    number = {f: i for i, f in enumerate(names)}
    longest, n = max(len(p) for p in each), len(pages)
    at = [(p, t, number[f]) for p, page in enumerate(each) for t, fs in enumerate(page) for f in fs]
    page_of, step_of, feature_of = np.array(at).T
    gold, real = np.zeros((longest, n), int), np.zeros((longest, n), bool)
    for p, (_, labels) in enumerate(pages):
        gold[:len(labels), p], real[:len(labels), p] = labels, True
    both = real[1:] & real[:-1]
    emit, move, first = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    flat = np.concatenate([emit.ravel(), move.ravel(), first])
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    hot = np.eye(2)[gold]
    for turn in range(1, rounds + 1):
        emit, move, first = flat[:emit.size].reshape(-1, 2), flat[emit.size:emit.size + 4].reshape(2, 2), flat[-2:]
        score = np.zeros((longest, n, 2))
        np.add.at(score, (step_of, page_of), emit[feature_of])
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[0] = score[0] + first
        for t in range(1, longest):
            ahead = np.logaddexp(alpha[t - 1][:, 0, None] + move[0], alpha[t - 1][:, 1, None] + move[1]) + score[t]
            alpha[t] = np.where(real[t][:, None], ahead, alpha[t - 1])
        for t in range(longest - 2, -1, -1):
            after = score[t + 1] + beta[t + 1]
            behind = np.logaddexp(after[:, 0, None] + move[:, 0], after[:, 1, None] + move[:, 1])
            beta[t] = np.where(real[t + 1][:, None], behind, 0)
        total = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
        chance = np.exp(alpha + beta - total[None, :, None])
        error = np.where(real[..., None], hot - chance, 0)
        g_emit = np.zeros_like(emit)
        np.add.at(g_emit, feature_of, error[step_of, page_of])
        pair = np.exp(alpha[:-1, :, :, None] + move + (score[1:] + beta[1:])[:, :, None, :] - total[None, :, None, None])
        g_move = ((hot[:-1, :, :, None] * hot[1:, :, None, :] - pair) * both[..., None, None]).sum(axis=(0, 1))
        slope = np.concatenate([g_emit.ravel(), g_move.ravel(), error[0].sum(axis=0)]) / n - penalty * flat / 10
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope ** 2
        flat = flat + rate * (mean / (1 - 0.9 ** turn)) / (np.sqrt(square / (1 - 0.999 ** turn)) + 1e-8)
    return Field(names, flat[:emit.size].reshape(-1, 2), flat[emit.size:emit.size + 4].reshape(2, 2), flat[-2:])


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 9) -> list[tuple[str, list[str]]]:
    """Pages of many layouts and the main blocks of each."""
    draw = np.random.default_rng(seed)
    pick = lambda options: options[int(draw.integers(len(options)))]
    syllables = "ta ri no ve la mi co den sur pel gor is un ber qua ".split()

    def prose(least: int, most: int) -> str:
        out = ["".join(pick(syllables) for _ in range(int(draw.integers(1, 4)))) for _ in range(int(draw.integers(least, most)))]
        return " ".join(out).capitalize() + pick([".", ".", ".", "!", "", "?"])

    def named(kind: str, tag: str | None = None) -> tuple[str, str]:
        tag = tag or pick(["div", "div", "section", "aside", "ul"])
        name = pick(OTHER_NAMES[kind])
        name = pick([name, name, f"{name}-{pick(['box', 'wrap', 'list', 'inner', 'container'])}", f"{pick(['site', 'page', 'article', 'post', 'main'])}-{name}"])
        return f'<{tag} {pick(["class", "class", "id", "role"])}="{name}">', f"</{tag}>"

    def menu() -> str:
        items = "".join(f'<li><a href="/x">{prose(1, 4)}</a></li>' for _ in range(int(draw.integers(2, 9))))
        return pick([f"<nav><ul>{items}</ul></nav>", "<ul>{}</ul>".join(named("menu", "div")).format(items), f"<nav>{items}</nav>"])

    def part(kind: str) -> str:
        plain = {"header": "header", "footer": "footer", "sidebar": "aside", "comments": "section"}.get(kind)
        start, end = (f"<{plain}>", f"</{plain}>") if plain and kind != "comments" and draw.random() < 0.5 else named(kind)
        body = "".join(pick(["<p>{}</p>", "<div>{}</div>", "{}", "<li>{}</li>", '<a href="/y">{}</a><br>']).format(prose(1, 30)) for _ in range(int(draw.integers(1, 5))))
        if kind == "footer" and draw.random() < 0.6:
            body += f"&copy; {prose(1, 5)} &middot; {prose(2, 20)}"
        if kind == "comments":
            body = f"<h3>{prose(1, 3)}</h3>" + body
        return start + body + end

    def form() -> str:
        return f"<form><label>{prose(1, 4)}</label><input><p>{prose(2, 12)}</p><button>{prose(1, 3)}</button></form>"

    pages = []
    for _ in range(n):
        main: list[str] = []

        def body(text: str, tag: str) -> str:
            main.append(text)
            if tag == "p" and draw.random() < 0.2:
                return f"<p><b>{text}<br>"
            return f"<ul><li>{text}</li></ul>" if tag == "li" else f"<{tag}>{text}</{tag}>"

        article = body(prose(2, 12), "h1") if draw.random() < 0.9 else ""
        for _ in range(int(draw.integers(1, 14))):
            tag = pick(["p"] * 9 + ["h2", "blockquote", "li", "pre"])
            article += body(prose(1, 5) if draw.random() < 0.15 else prose(4, 80), tag)
            if draw.random() < 0.08:
                tag = pick(["p", "div", "div", "section"])
                article += f'<{tag} {pick(["hidden", "style=display:none", "aria-hidden=true"])}>{pick(["", "<p>"])}{prose(2, 40)}</{tag}>'
            if draw.random() < 0.12:
                article += pick([lambda: part("advert"), lambda: part("share"), lambda: part("sidebar"), form, lambda: part("notice")])()
        if draw.random() < 0.2:
            article += part("comments")
        name = pick(MAIN_NAMES)
        article = pick(["<article>{}</article>", "<article>{}</article>", "<article>{}</article>", f'<article class="{name}">{{}}</article>', "<main>{}</main>",
                        f'<main><article>{{}}</article></main>', f'<div class="{name}">{{}}</div>', f'<div class="{name}-{pick(MAIN_NAMES)}">{{}}</div>',
                        f'<div id="{name}">{{}}</div>', f'<section class="{name}">{{}}</section>', "<div>{}</div>"]).format(article)
        before = [menu() if draw.random() < 0.8 else "", part("header") if draw.random() < 0.5 else "", part("notice") if draw.random() < 0.3 else "",
                  part("advert") if draw.random() < 0.5 else "", form() if draw.random() < 0.15 else ""]
        after = [part("sidebar") if draw.random() < 0.4 else "", part("comments") if draw.random() < 0.4 else "", part("advert") if draw.random() < 0.3 else "",
                 form() if draw.random() < 0.15 else "", part("footer") if draw.random() < 0.9 else ""]
        head = f"<html><head><title>{prose(2, 9)}</title><style>p{{}}</style><script>var x=1;</script></head><body>"
        pages.append((head + "".join(np.array(before, object)[draw.permutation(5)]) + article + "".join(after) + pick(["</body></html>", ""]), main))
    return pages


def with_labels(page: str, main: list[str]) -> tuple[list[Block], list[int]]:
    """The blocks of a page and whether each is one of its main blocks, taken in order."""
    blocks, left = leaf_blocks(page), [" ".join(markup.unescape(m).split()) for m in main]
    labels = []
    for block in blocks:
        is_main = bool(left) and block.text == left[0]
        labels.append(int(is_main))
        if is_main:
            left.pop(0)
    return blocks, labels


def trained(pages: list[tuple[str, list[str]]] | None = None) -> Field:
    return fit([with_labels(*p) for p in pages or labelled_pages()])


def _extract(field: Field):
    def text_of(page: str | None) -> str:
        blocks = leaf_blocks(page)
        return "\n\n".join(b.text for b, label in zip(blocks, field.decode(blocks)) if label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            texts = pa.array([text_of(page.as_py()) for page in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["row", "text"])

    return run


def main_texts(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """The columns of ``pages`` but html, and text and n_chars."""
    row = F.struct(*(c for c in pages.columns if c not in ("html", "text", "n_chars")))
    kind = pages.select(row.alias("row")).schema["row"].dataType.simpleString()
    return pages.select(row.alias("row"), "html").mapInArrow(_extract(field or trained()), f"row {kind}, text string") \
        .select("row.*", "text", F.length("text").cast("long").alias("n_chars"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


QUERIES = {"op9_main_text": op9_main_text}
ORACLES: dict[str, str] = {}
