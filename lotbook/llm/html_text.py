"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of a page.

A page is read once into blocks: runs of text between block-level tags, without scripts, styles, comments, drawings and
controls; of formulas the text is kept, but not the notes on them. What is left out ends at its end tag, or at that of an
element around it; an empty ``<svg/>`` leaves nothing out. A block is described by its ancestors (tags, and words of their class, id and role) and by its text (length,
links, last character, place). Two labels, main or not, are scored by these features and by the label before, and
decoded by Viterbi.

The model is fitted on labelled pages of two kinds, both bounded in number: whole pages of the table whose markup says
where the article is, and pages laid out anew from their sentences with known roles (menus, notices, adverts,
forms, comments and so on under many common names), so that also pages without telling tags are understood.

Nulls and odd input: a null or empty page has an empty text. Cut-off tags at the end are no text; elements that are never
closed end with the page. Repeated rows are extracted alike. Without any page to learn from, the laid-out pages use
a few stock words. All input columns ride along in ``row``.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotbook.llm.rows import carried, text_column

SAMPLE = 200  # pages that a model learns from
LAYOUTS, ROUNDS, STEP, DECAY = 500, 250, 0.15, 2e-4
#: Left out; in the first ones tags are text.
RAW = set("script style textarea title iframe noscript".split())
SKIPPED = RAW | set("template svg object canvas select annotation annotation-xml".split())
FOREIGN = {"svg", "annotation", "annotation-xml"}  # <svg/> is an empty element, <canvas/> only begins one
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?/][^>]*>|<[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<""".replace("\n    ", ""),
    re.DOTALL,
)
CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in RAW}
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section summary table tbody td"
    " tfoot th thead tr ul".split()
)
#: Elements that set a part of a page off from the rest; the innermost, or the innermost with a name, is a feature.
PARTED = {"article", "aside", "dialog", "footer", "form", "header", "main", "menu", "nav", "section"}
#: An opening tag that ends one of these, if it is the innermost element.
ENDS = {"li": {"li", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "tr": {"tr", "td", "th", "p"},
        "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
LABEL = re.compile(r'data-y="([01])"')


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]
    names: tuple[str, ...]
    parents: tuple[tuple[str, list[str]], ...]
    linked: float
    label: int | None


def _names(attributes: str) -> list[str]:
    found = (a or b or c for a, b, c in NAMES.findall(attributes))
    return [part for name in found for part in re.split(r"[^a-z0-9]+", name.lower()) if part]


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, list[str], int | None]] = []
    parts: list[str] = []
    chars = links = inside = 0

    def flush() -> None:
        nonlocal chars, links
        text = " ".join("".join(parts).split())
        if text:
            labels = [y for _, _, y in stack if y is not None]
            names = tuple(n for _, more, _ in stack for n in more)
            out.append(Block(text, tuple(t for t, _, _ in stack), names, tuple((t, n) for t, n, _ in stack), links / max(chars, 1), labels[-1] if labels else None))
        parts.clear()
        chars = links = 0

    def raw_end(name: str, start: int) -> int | None:
        """Where an element ends in which tags are text; a script that is never closed goes on to the end of the page."""
        if name not in RAW or name in unclosed:
            return None
        found = CLOSING[name].search(page, start)
        if found:
            return found.end()
        if name in ("script", "style"):
            return len(page)
        unclosed.add(name)
        return None

    at_char, unclosed = 0, set()
    skipped: list[str] = []  # elements open within one that is left out, and that one
    within, around = Counter(), Counter()  # names in ``skipped``, and of the elements open around it
    while token := TOKEN.match(page, at_char):
        at_char = token.end()
        whole = token.group(0)
        if whole[0] != "<" or len(whole) == 1:
            if not skipped:
                piece = html.unescape(whole)
                parts.append(piece)
                chars += len(piece)
                links += len(piece) * (inside > 0)
            continue
        name = token.group(2)
        if name is None:
            continue
        name, closing, empty = name.lower(), bool(token.group(1)), token.group(3).rstrip().endswith("/")
        if skipped:
            if not closing:
                if name not in VOID and not empty:
                    at_char = raw_end(name, at_char) or at_char
                    if at_char == token.end():
                        skipped.append(name)
                        within[name] += 1
                continue
            if within[name]:
                while (last := skipped.pop()) != name:
                    within[last] -= 1
                within[name] -= 1
                continue
            if not around[name]:
                continue
            skipped.clear(), within.clear()  # the element around it ends
        elif name in SKIPPED:
            if not closing:
                if name != "title":
                    parts.append(" ")
                if not (empty and name in FOREIGN):
                    at_char = raw_end(name, at_char) or at_char
                    if at_char == token.end():
                        skipped.append(name)
                        within[name] += 1
            continue
        if closing:
            around[name] = max(0, around[name] - 1)
        elif name not in VOID and not empty:
            around[name] += 1
        if name == "a":
            inside = max(0, inside - 1) if closing else 1
        elif name == "br":
            parts.append(" ")
        if name not in BLOCKS:
            continue
        flush()
        if closing:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                del stack[at:]
        elif name != "hr":
            inside = 0
            while stack and stack[-1][0] in ENDS.get(name, {"p"}):
                stack.pop()
            attributes = token.group(3)
            label = LABEL.search(attributes)
            if not attributes.rstrip().endswith("/"):
                stack.append((name, _names(attributes), int(label.group(1)) if label else None))
    flush()
    return out


def features(found: list[Block]) -> list[set[str]]:
    out = []
    for i, block in enumerate(found):
        words = block.text.count(" ") + 1
        f = {"all", f"o:{block.tags[-1] if block.tags else ''}", f"len:{min(words.bit_length(), 6)}", f"end:{block.text[-1] in '.!?'}",
             f"link:{int(3.99 * block.linked)}", f"place:{3 * i // len(found)}", f"sign:{any(c in block.text for c in '©®»›|')}"}
        f.update(f"t:{t}" for t in block.tags)
        f.update(f"c:{n}" for n in block.names)
        part, names = next(((t, n) for t, n in reversed(block.parents) if n or t in PARTED), ("", ()))
        f.add(f"in:{part}")
        f.update(f"in.{n}" for n in names)
        out.append(f)
    return out


@dataclass
class Field:
    """Weights of label 1 over label 0, and of each label after another."""

    weight: dict[str, float]
    start: np.ndarray
    follow: np.ndarray

    def decode(self, found: list[Block]) -> list[bool]:
        """The best labels of all (Viterbi)."""
        if not found:
            return []
        weigh = self.weight.get
        (a, b), ((aa, ab), (ba, bb)) = self.start.tolist(), self.follow.tolist()
        back = []
        for i, f in enumerate(features(found)):
            e = sum(weigh(name, 0.0) for name in f)
            if i == 0:
                b += e
                continue
            back.append((a + aa < b + ba, a + ab < b + bb))
            a, b = max(a + aa, b + ba), max(a + ab, b + bb) + e
        label = b > a
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]

    def main_text(self, page: str | None) -> str:
        found = blocks(page or "")
        return " ".join(b.text for b, main in zip(found, self.decode(found)) if main)


def fit_field(pages: list[list[Block]]) -> Field:
    """Gradient ascent on the likelihood of the labels, all pages side by side."""
    pages = [p for p in pages if p]
    described = [features(p) for p in pages]
    names = sorted({n for page in described for f in page for n in f})
    index = {n: i for i, n in enumerate(names)}
    count, longest = len(pages), max(map(len, pages))
    y, real = np.zeros((count, longest), dtype=np.int64), np.zeros((count, longest), dtype=bool)
    for i, page in enumerate(pages):
        y[i, : len(page)], real[i, : len(page)] = [block.label for block in page], True
    # numbers of the features of all blocks one after the other, and where those of a block begin
    held = [np.fromiter(sorted(index[n] for n in f), dtype=np.int64, count=len(f)) for page in described for f in page]
    cells, sizes = np.concatenate(held), np.array([len(h) for h in held])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    w, start, follow = np.zeros(len(names)), np.zeros(2), np.zeros((2, 2))
    past = [np.full(p.shape, 1e-8) for p in (w, start, follow)]
    goal_follow = np.zeros((2, 2))
    both = real[:, 1:]
    np.add.at(goal_follow, (y[:, :-1][both], y[:, 1:][both]), 1)
    goal_start = np.bincount(y[:, 0], minlength=2).astype(float)
    last = real.sum(1) - 1
    for _ in range(ROUNDS):
        score = np.zeros((count, longest, 2))
        score[real, 1] = np.add.reduceat(w[cells], begins)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = start + score[:, 0]
        for t in range(1, longest):
            ahead[:, t] = score[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + follow, axis=1)
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(follow + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(real[:, t + 1, None], step, 0)
        total = np.logaddexp.reduce(ahead[np.arange(count), last], axis=1)
        p = np.exp(np.minimum(ahead + behind - total[:, None, None], 0))
        pair = ahead[:, :-1, :, None] + follow + (score + behind)[:, 1:, None, :] - total[:, None, None, None]
        pair = np.exp(np.minimum(pair, 0))[both].sum(0)
        gap = np.bincount(cells, np.repeat((y - p[:, :, 1])[real], sizes), len(names))
        steps = (gap / count - DECAY * w, (goal_start - p[:, 0].sum(0)) / count, (goal_follow - pair) / count)
        for value, seen, g in zip((w, start, follow), past, steps):
            seen += g * g
            value += STEP * g / np.sqrt(seen)
    return Field(dict(zip(names, w.tolist())), start, follow)


# Usual names of page parts. %s is the text, already in tags or not.
FRAMES = (
    "<article data-y=1>%s</article>", "<main><article data-y=1>%s</article></main>", "<main data-y=1>%s</main>",
    "<div class=content data-y=1>%s</div>", "<div id=content data-y=1>%s</div>", "<div class=post-content data-y=1>%s</div>",
    "<div class=entry-content data-y=1>%s</div>", "<div class=article-body data-y=1>%s</div>", "<section class=story data-y=1>%s</section>",
    "<div class=post data-y=1>%s</div>", "<article class=post data-y=1>%s</article>", "<div class=text data-y=1>%s</div>",
    "<div id=main data-y=1>%s</div>", "<div data-y=1>%s</div>",
)
PARTS = (
    "<nav>%l</nav>", "<nav class=menu>%l</nav>", "<div class=menu>%l</div>", "<div class=navbar>%l</div>", "<div id=nav>%l</div>",
    "<div class=breadcrumbs>%l</div>", "<ul class=navigation>%l</ul>", "<header>%t</header>", "<header><h1>%t</h1>%l</header>",
    "<div class=header>%t</div>", "<div id=header><p>%t</p></div>", "<div class=masthead>%t</div>", "<footer>%t</footer>",
    "<footer><p>%t</p>%l</footer>", "<div class=footer>%t</div>", "<div id=footer><p>© %t</p></div>", "<aside>%p</aside>",
    "<aside><h3>%t</h3>%l</aside>", "<div class=sidebar>%p</div>", "<div id=sidebar>%l</div>", "<div class=widget>%l</div>",
    "<div class=related>%l</div>", "<section class=related-posts><h2>%t</h2>%l</section>", "<div class=ad>%t</div>", "<div class=ads>%p</div>",
    "<div class=advert>%p</div>", "<div class=advertisement>%t</div>", "<div id=ad-top>%t</div>", "<div class=sponsored>%p</div>",
    "<div class=promo>%p</div>", "<div class=banner>%t</div>", "<div class=notice>%p</div>", "<div class=cookie-notice>%p</div>",
    "<div id=cookie-banner>%t</div>", "<div class=consent><p>%t</p><button>%t</button></div>", "<div class=alert>%t</div>",
    "<div role=dialog class=popup>%p</div>", "<div class=modal>%p</div>", "<form><label>%t</label><input><button>%t</button></form>",
    "<form class=search>%t</form>", "<form>%p</form>", "<form class=signup>%p<button>%t</button></form>", "<div class=newsletter><p>%t</p><form><button>%t</button></form></div>", "<div class=subscribe>%p</div>",
    "<section class=comments>%c</section>", "<section id=comments><h2>%t</h2>%c</section>", "<div class=comments>%c</div>",
    "<ol class=comment-list><li class=comment>%p</li><li class=comment>%p</li></ol>", "<div class=comment>%p</div>", "<div id=disqus>%p</div>",
    "<div class=replies><div class=reply>%p</div></div>", "<div class=reader-comments>%c</div>", "<div class=share>%l</div>",
    "<div class=social>%l</div>", "<div class=tags>%l</div>", "<div class=pagination>%l</div>", "<div class=toolbar>%t</div>",
    "<div class=login>%t</div>", "<div class=copyright>© %t</div>", "<div class=disclaimer>%t</div>",
)
STOCK = ["some words of a text that nobody wrote.", "another short line with a few words in it.", "more of the same and a little longer than before."]


def layouts(texts: list[str]) -> list[str]:
    """Pages with known roles, laid out from sentences."""
    draw = np.random.default_rng(11)
    texts = texts or STOCK

    def some(least: int, most: int) -> str:
        words = texts[draw.integers(len(texts))].split()
        n = int(draw.integers(least, most))
        at = int(draw.integers(max(1, len(words) - n + 1)))
        return html.escape(" ".join(words[at : at + n])) + ("." if n > 6 and draw.random() < 0.8 else "")

    def fill(pattern: str) -> str:
        links = lambda tag: "".join(f"<{tag}><a href=/x>{some(1, 4)}</a></{tag}>" for _ in range(draw.integers(2, 7)))
        paragraph = lambda: f"<p>{some(5, 60)}</p>" * 1
        out = []
        for piece in re.split("(%[ltpc])", pattern):
            if piece == "%l":
                out.append(f"<ul>{links('li')}</ul>" if draw.random() < 0.7 else links("span"))
            elif piece == "%t":
                out.append(some(2, 14))
            elif piece == "%p":
                out.append(paragraph() + (paragraph() if draw.random() < 0.4 else "") if draw.random() < 0.7 else some(5, 40))
            elif piece == "%c":
                out.append("".join(f"<div class=comment><b>{some(1, 2)}</b>{paragraph()}</div>" for _ in range(draw.integers(1, 5))))
            else:
                out.append(piece)
        return "".join(out)

    def junk() -> str:
        part = fill(PARTS[draw.integers(len(PARTS))])
        return re.sub(r"^<(\w+)", r'<\1 data-y="0"', part)

    def article() -> str:
        out = [f"<h1>{some(2, 10)}</h1>"] if draw.random() < 0.8 else []
        for _ in range(draw.integers(1, 9)):
            kind = draw.random()
            if kind < 0.62:
                link = f" <a href=/y>{some(1, 4)}</a> " if draw.random() < 0.2 else " "
                out.append(f"<p>{some(4, 60)}{link}{some(1, 20)}</p>")
            elif kind < 0.70:
                out.append(f"<h2>{some(1, 8)}</h2>")
            elif kind < 0.77:
                out.append("<ul>" + "".join(f"<li>{some(2, 15)}</li>" for _ in range(draw.integers(2, 5))) + "</ul>")
            elif kind < 0.82:
                out.append(f"<blockquote>{some(5, 30)}</blockquote>")
            elif kind < 0.86:
                out.append(f"<table><tr><td>{some(1, 4)}</td><td>{some(1, 4)}</td></tr></table>")
            elif kind < 0.90:
                out.append(f"<figure><figcaption>{some(3, 12)}</figcaption></figure>")
            elif kind < 0.93:
                out.append(f"<pre>{some(3, 20)}</pre>")
            else:
                out.append(junk())
        return "".join(out)

    pages = []
    for _ in range(LAYOUTS):
        before = "".join(junk() for _ in range(draw.integers(0, 5)))
        after = "".join(junk() for _ in range(draw.integers(0, 5)))
        body = FRAMES[draw.integers(len(FRAMES))].replace("data-y=1", 'data-y="1"') % article()
        if draw.random() < 0.15:  # no element around the text
            body = article()
            pages.append(f'<html><body data-y="1">{before}{body}{after}</body></html>')
            continue
        pages.append(f'<html><body data-y="0">{before}{body}{after}</body></html>')
    return pages


def by_markup(found: list[Block]) -> list[Block]:
    """Labels for a page whose markup says where the article is; none for other pages."""
    outside = {"nav", "aside", "footer", "header", "form", "button"}
    parts = {"ad", "ads", "comments", "comment", "menu", "sidebar", "notice"}
    if not any("article" in b.tags for b in found):
        return []
    for block in found:
        block.label = int("article" in block.tags and not outside & set(block.tags) and not parts & set(block.names))
    return found


def fit(pages: DataFrame, sample: int = SAMPLE) -> Field:
    """Learn from about ``sample`` pages, chosen by a hash, which come to the driver whole."""
    total = pages.count()
    share = min(1.0, sample / max(total, 1))
    place = F.pmod(F.xxhash64("page_id", "url"), F.lit(2**30))
    rows = pages.where(place < int(share * 2**30)).select("page_id", "html").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["page_id"] is None, r["page_id"] or 0, r["html"] or ""))
    read = [blocks(r["html"] or "") for r in rows]
    texts = [b.text for page in read for b in page if b.text.count(" ") >= 4]
    labelled = [by_markup(page) for page in read]
    made = [[b for b in blocks(page) if b.label is not None] for page in layouts(texts)]
    return fit_field(labelled + made)


def _extracted(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [field.main_text(page) for page in text_column(batch, "html")]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, type=pa.string())], names=["row", "text"])


def main_texts(pages: DataFrame, field: Field) -> DataFrame:
    """row (the columns without html), text: one row a page, without a shuffle."""
    wide = pages.select(carried(pages.drop("html")), "html")
    kind = wide.schema["row"].dataType.simpleString()
    return wide.mapInArrow(lambda batches: _extracted(batches, field), f"row {kind}, text string")
