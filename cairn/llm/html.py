"""HTML extraction by consensus of a host's pages.

Each page is cut into blocks and containers. Containers are scored by the running text in
them, and the page votes for the path of the one that holds its article: the tags and
classes from the root, without numbers. Spark counts the votes of each host, and every page
is extracted again: all that stands at its host's winning path and in its own best container,
and the running text and headings around them. Only what is mostly links, or shown to be
teasers of other articles, is left out.
"""

from __future__ import annotations

import html as entities
import json
import re

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.urls import host_of
from cairn.plans.durable import durable, pick

# Elements by what they are, and words in class, id and role that name what
# isn't part of an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body div main section td".split())
DROPPED = frozenset("aside button datalist dialog fieldset footer form head header iframe input label legend menu nav noscript object optgroup option script select style svg template textarea title canvas audio video map math".split())
UNWANTED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promotions banner cookie cookies consent gdpr notice notices notification alert popup modal overlay menu menus nav navbar navigation topnav breadcrumb breadcrumbs sidebar sidebars aside footer header masthead comment comments commentlist discussion disqus reply replies respond responses share sharing social related recommended recommendations newsletter subscribe subscription signup login search searchform form pagination pager widget widgets toolbar skip contentinfo complementary dialog".split()
)
#: A list of other articles by its class or id, and one of them, if a block in it is all link.
LISTS = frozenset("teasers previews excerpts".split())
CARDS = frozenset("teaser preview excerpt".split())
#: A class with one of these tells how a part is laid out, not what it is.
LAID_OUT = frozenset("has no with without is not overflow".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMS = frozenset("form fieldset".split())
AROUND = frozenset("aside button footer header label legend nav select optgroup option datalist".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
OPTIONAL_END = frozenset("dd dt head li option p td th tr".split())
#: What begins the next part of a page, if a dropped element before it has no end tag: after a
#: label and its like any block, after a menu or header another part of the page.
PARTS = frozenset("article aside body footer h1 header main nav section".split())
NEXT = PARTS | {"div"}
ENDED_BY = dict.fromkeys("button label legend select option optgroup datalist".split(), BLOCKS) | dict.fromkeys("aside footer header nav".split(), PARTS)
MAIN, ARTICLE = 1, 2
LEAST_FORM = 200  # characters of running text that make a form a page, if it has no heading
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
STOPS = {tag: (CONTAINERS | SCOPES[tag]) - CLOSED_BY[tag] for tag in CLOSED_BY}
RAW_ENDS = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}

# Comments, tags (an open quote ends with the tag), declarations, and a tag cut off at the end.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]++|"[^"]*"|'[^']*')*+|[^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
NAMES = re.compile(r"[a-z]+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def unwanted(tokens: str) -> bool:
    """Whether a class, id or role names something that isn't an article.

    A token does by its first or last word: ``comment-list``, ``topNav``, not ``has-sidebar``.
    """
    for token in HUMP.sub("-", tokens).lower().split():
        words = NAMES.findall(token)
        if words and (words[0] in UNWANTED or words[-1] in UNWANTED) and LAID_OUT.isdisjoint(words):
            return True
    return False


def _unclosed(source: str) -> frozenset[int]:
    """Where elements begin whose tag is never closed, tags matched with their own kind only."""
    held: dict[str, list[int]] = {}
    for found in TAG.finditer(source):
        if found[2]:
            tag = found[2].lower()
            if not found[1]:
                held.setdefault(tag, []).append(found.start())
            elif held.get(tag):
                held[tag].pop()
    return frozenset(i for tag, starts in held.items() if tag not in OPTIONAL_END and tag not in VOID for i in starts)


def _path_key(path: str) -> int:
    """The hash of a path, step by step as ``Page`` takes it."""
    key = 0
    for step in path.split("/")[1:]:
        key = xxhash.xxh3_64_intdigest(step.encode(), key)
    return key


class Page:
    """Blocks of text and containers of a page, read once from left to right.

    ``blocks`` has [container, text, points, share of the text outside links, whether it is a
    heading]; ``parents``, ``keys`` (a hash of the path), ``kinds`` and ``names`` are by
    container. What belongs to dropped elements isn't read at all, but for forms: one that
    holds most of the page's running text is how the page is built, and stays.

    Work and memory are in proportion to the page, however deep or badly closed its elements
    are: a path is kept as its last step and what that stands on, and open elements are found
    by their tag.
    """

    def __init__(self, source: str):
        if not self._read(source, frozenset()):
            # A dropped element ended with something else: those without an end tag of their
            # own are known now, and end where the next part of the page begins.
            self._read(source, _unclosed(source))
        self._score()

    @classmethod
    def unpacked(cls, data: bytes) -> Page:
        """A page from what ``packed`` gave."""
        page = cls.__new__(cls)
        page.blocks, page.parents, page.keys, page.kinds, page.names = json.loads(zstandard.decompress(data))
        page._score()
        return page

    def packed(self) -> bytes:
        """What extraction needs: much smaller than the page, and read in a fraction of the time."""
        return zstandard.compress(json.dumps([self.blocks, self.parents, self.keys, self.kinds, self.names], ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"), 1)

    def _score(self) -> None:
        self.points = [0.0] * len(self.parents)  # with all that lies below
        for c, _, points, _, _ in self.blocks:
            self.points[c] += points
        for c in range(len(self.parents) - 1, 0, -1):  # parents come before children
            self.points[self.parents[c]] += self.points[c]

    def path(self, c: int) -> str:
        """Tags and class words from the root to a container."""
        steps, at = [], self.at[c]
        while at >= 0:
            at, step = self.steps[at]
            steps.append(step)
        return "".join(f"/{x}" for x in reversed(steps))

    def _read(self, source: str, unclosed: frozenset[int]) -> bool:
        """Read the page; whether every dropped element had an end of its own, or was known not to."""
        self.blocks: list[list] = []
        self.parents, self.keys, self.kinds, self.names, self.at = [-1], [0], [0], [0], [-1]
        self.steps: list[tuple[int, str]] = []  # of a path: what it stands on, tag and classes
        regions: list[list[int]] = []  # of forms: the region around, whether it is like a page
        of_block: list[int] = []
        open_: list[tuple] = []  # tag, container, path, its hash, region, what was dropped before, whether it ends with the next part
        where: dict[str, list[int]] = {}  # places of the open elements of a tag
        dropped = 0  # 0: nothing, 1: until the element ends or the main part begins, 2: whatever comes
        holds = [-1]  # places of the open containers
        loose: list[int] = []  # places of dropped elements that end with the next part
        held: list[str] = []
        links = in_link = headings = 0
        sound = True

        def flush():
            nonlocal links
            if held:
                text = " ".join("".join(held).split())
                if text:
                    running = max(0.0, 1 - links / len(text))
                    points = (len(text) / 100 + 0.2 * text.count(",")) * running
                    self.blocks.append([open_[-1][1] if open_ else 0, text, points, running, headings > 0])
                    of_block.append(open_[-1][4] if open_ else -1)
                held.clear()
            links = 0

        def close(upto: int, own: bool = False):
            nonlocal dropped, in_link, headings, sound
            gone = open_[upto:]
            if any(t[0] in BLOCKS for t in gone):
                flush()
            for i, t in enumerate(gone):
                where[t[0]].pop()
                if t[0] in CONTAINERS:
                    holds.pop()
                in_link -= t[0] == "a"
                headings -= t[0] in HEADINGS
                if t[7] and t[6]:
                    loose.pop()
                elif t[7] and t[0] not in OPTIONAL_END and not (own and i == 0):
                    sound = False
            dropped = gone[0][5]
            del open_[upto:]

        def place(tag: str) -> int:
            at = where.get(tag)
            return at[-1] if at else -1

        at = 0
        while True:
            found = TAG.search(source, at)
            text = source[at : found.start() if found else len(source)]
            if text:
                if dropped and open_[-1][0] == "head" and not text.isspace():
                    close(len(open_) - 1, True)
                if not dropped:
                    text = entities.unescape(text)
                    held.append(text)
                    links += len(text) * (in_link > 0)
            if not found:
                break
            at = found.end()
            if not found[2]:
                continue
            tag = found[2].lower()
            if found[1]:
                upto = place(tag)
                if upto >= 0:
                    close(upto, True)
                elif tag in BLOCKS and not dropped:
                    flush()
                continue
            if where.get("head") and (tag == "body" or open_[-1][0] == "head" and tag not in IN_HEAD):
                close(place("head"), True)
            if tag in RAW:
                end = RAW_ENDS[tag].search(source, at)
                after = source.find(">", end.start()) if end else -1
                at = after + 1 if after >= 0 else len(source)
                continue
            if tag in ("br", "hr"):
                if not dropped:
                    flush()
                continue
            if tag in VOID:
                continue
            if tag in BLOCKS:
                while dropped and loose and tag in ENDED_BY.get(open_[loose[-1]][0], NEXT):
                    close(loose[-1])
                ends = CLOSED_BY.get(tag, ())
                while where.get("p") or ends:
                    p, same = place("p"), max([place(t) for t in ends], default=-1)
                    if max(p, same) <= (max([place(t) for t in STOPS[tag]]) if ends else holds[-1]):
                        break
                    close(max(p, same))
                    if same > p:
                        break
                if not dropped:
                    flush()
            names, told, gone = self._names(tag, found[3])
            holder, step, key, region = open_[-1][1:5] if open_ else (0, -1, 0, -1)
            is_main = tag == "main" or "role=main" in names
            before, is_loose = dropped, found.start() in unclosed
            if is_main and dropped == 1 and not gone:
                dropped = 0
            drops = bool(gone) and dropped < gone
            if tag in FORMS and not gone and not dropped:
                regions.append([region, 0])
                region = len(regions) - 1
            if drops:
                dropped = gone
                if is_loose:
                    loose.append(len(open_))
            if tag in BLOCKS:
                own = tag + "".join(f".{n}" for n in names)
                key = xxhash.xxh3_64_intdigest(own.encode(), key)
                if not dropped:
                    self.steps.append((step, own))
                    step = len(self.steps) - 1
            if tag in CONTAINERS and not dropped:
                self.parents.append(holder)
                self.keys.append(key)
                self.kinds.append(MAIN if is_main else ARTICLE if tag == "article" else 0)
                self.names.append((1 if told & LISTS else 0) | (2 if told & CARDS else 0))
                self.at.append(step)
                holder = len(self.parents) - 1
            if region >= 0 and (is_main or tag == "article" or tag in HEADINGS):
                regions[region][1] = 1
            where.setdefault(tag, []).append(len(open_))
            if tag in CONTAINERS:
                holds.append(len(open_))
            open_.append((tag, holder, step, key, region, before, is_loose, drops))
            in_link += tag == "a"
            headings += tag in HEADINGS
        flush()
        if any(t[7] and not t[6] and t[0] not in OPTIONAL_END for t in open_):
            sound = False
        if regions:
            self._leave_forms(regions, of_block)
        return sound or bool(unclosed)

    def _leave_forms(self, regions: list[list[int]], of_block: list[int]) -> None:
        """Drop the blocks of forms, but of those that hold most of the running text."""
        held = [0.0] * len(regions)
        for (_, text, _, running, _), r in zip(self.blocks, of_block, strict=True):
            if r >= 0:
                held[r] += len(text) * running
        total = sum(len(b[1]) * b[3] for b in self.blocks)
        for r in range(len(regions) - 1, -1, -1):
            if regions[r][0] >= 0:
                held[regions[r][0]] += held[r]
                regions[regions[r][0]][1] |= regions[r][1]
        stays: list[bool] = []
        for (around, like_a_page), n in zip(regions, held, strict=True):
            stays.append((around < 0 or stays[around]) and 2 * n > total and (like_a_page or n >= LEAST_FORM))
        self.blocks = [b for b, r in zip(self.blocks, of_block, strict=True) if r < 0 or stays[r]]

    @staticmethod
    def _names(tag: str, rest: str) -> tuple[list[str], frozenset[str], int]:
        """Words of the class without numbers, those of class and id, and how the element is dropped."""
        gone, names, told = 0 if tag not in DROPPED or tag in FORMS else 1 if tag in AROUND else 2, [], frozenset()
        if "=" in rest or "hidden" in rest:
            for name, value in ATTRIBUTE.findall(rest):
                name, value = name.lower(), value.strip("\"'")
                if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    gone = 2
                elif name in ("class", "id", "role") and value:
                    if not gone and tag not in ("html", "body", "main", "article") and unwanted(value):
                        gone = 1
                    words = NAMES.findall(value.lower())
                    told |= frozenset(words) if name != "role" else frozenset()
                    if name == "class":
                        names += sorted(set(words))
                    elif name == "role" and value.lower() == "main":
                        names.append("role=main")
        return names, told, gone

    def best(self) -> int:
        """The container that the article is looked for around.

        That of an article or main element with half of the page's running text, or else
        the innermost that holds three quarters of it.
        """
        total = self.points[0]
        named = [c for c in range(1, len(self.parents)) if self.kinds[c] and self.points[c] >= 0.5 * total]
        if named and total:
            return max(named, key=lambda c: (self.kinds[c] == ARTICLE, self.points[c], -c))
        return max((c for c in range(len(self.parents)) if self.points[c] >= 0.75 * total), default=0) if total else 0

    def below(self, containers) -> list[bool]:
        """Whether each container is one of these or lies in one."""
        inside = [False] * len(self.parents)
        for c in range(len(self.parents)):  # parents come before children
            inside[c] = c in containers or (self.parents[c] >= 0 and inside[self.parents[c]])
        return inside

    def above(self, containers) -> set[int]:
        """These containers and all around them."""
        found = set()
        for c in containers:
            while c >= 0 and c not in found:
                found.add(c)
                c = self.parents[c]
        return found

    def teasers(self) -> set[int]:
        """Containers whose names and links say that they hold teasers."""
        linked = self.above({c for c, _, _, running, _ in self.blocks if running == 0})
        return {c for c, names in enumerate(self.names) if names & 1 or (names & 2 and c in linked)}

    def mostly_text(self) -> list[bool]:
        """Whether at least half of each container's text is outside links."""
        all_, running = [0] * len(self.parents), [0.0] * len(self.parents)
        for c, text, _, share, _ in self.blocks:
            all_[c] += len(text)
            running[c] += len(text) * share
        for c in range(len(self.parents) - 1, 0, -1):
            all_[self.parents[c]] += all_[c]
            running[self.parents[c]] += running[c]
        return [2 * r >= n for r, n in zip(running, all_, strict=True)]

    def main_text(self, path: str | None) -> str:
        """The article: the own best container, those at the host's ``path``, and the text around.

        The best container at the path and the own best one are taken whole, and so is every
        container beside them that is mostly text. Of those around them and of lists of links
        the blocks that are mostly text are taken, and a heading before such a block. Teasers
        beside the path are left out if the path has a quarter of the own best container's
        points; else the article lies elsewhere and nothing is left out.
        """
        own = self.best()
        key = _path_key(path) if path else None
        same = {c for c in range(1, len(self.parents)) if self.keys[c] == key}
        inside = self.below(same)
        top = {c for c in same if self.parents[c] < 0 or not inside[self.parents[c]]}
        core, gone = {own}, set()
        if top and 4 * sum(self.points[c] for c in top) >= self.points[own]:
            core.add(max(top, key=lambda c: (self.points[c], -c)))
            gone = {c for c in self.teasers() - self.above(top) if not inside[c]}
        around, texts = self.above(core), self.mostly_text()
        left_out, whole = self.below(gone), self.below(core | {c for c in range(len(self.parents)) if texts[c] and c not in around})
        taken = [not left_out[c] and (whole[c] or running >= 0.5) for c, _, _, running, _ in self.blocks]
        for i, (c, _, _, _, heading) in enumerate(self.blocks[:-1]):
            if heading and not taken[i] and not left_out[c]:
                taken[i] = taken[i + 1]
        return "\n".join(b[1] for b, t in zip(self.blocks, taken, strict=True) if t)


READ = "path string, points double, page binary"
SALTS = 64  # parts of a host, where the hosts' paths are too many to broadcast


def _reader(kinds: list[str]):
    """Pages read once: the columns handed on, the vote and what extraction needs."""
    names = [f"_keep{i}" for i in range(len(kinds))] + ["host"]

    def read(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                pages = [Page(h or "") for h in some.column(some.num_columns - 1).to_pylist()]
                best = [p.best() for p in pages]
                cols = [pa.array([p.path(c) or None for p, c in zip(pages, best, strict=True)], pa.string()), pa.array([p.points[c] for p, c in zip(pages, best, strict=True)], pa.float64()), pa.array([p.packed() for p in pages], pa.binary())]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *cols], names=[*names, "path", "points", "page"])

    return read


def _extractor():
    def extract(page: pa.Array, path: pa.Array) -> pa.Array:
        return pa.array([Page.unpacked(d).main_text(p) for d, p in zip(page.to_pylist(), path.to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(extract, T.StringType())


def _read_pages(pages: DataFrame, url_col: str, html_col: str, keep: tuple[str, ...]) -> DataFrame:
    """Pages in parts: the columns of ``keep`` as _keep0 and so on, host, path, points, page; written."""
    d = pick(pages, _url=url_col, _html=html_col, **{f"_keep{i}": k for i, k in enumerate(keep)})
    d = d.select(*[f"_keep{i}" for i in range(len(keep))], host_of(F.col("_url").cast("string")).alias("host"), F.col("_html").cast("string").alias("_html"))
    kinds = [d.schema[f"_keep{i}"].dataType.simpleString() for i in range(len(keep))]
    schema = ", ".join([*[f"_keep{i} {k}" for i, k in enumerate(kinds)], "host string", READ])
    return durable(d.mapInArrow(_reader(kinds), schema), "pages-read")


def _winners(read: DataFrame) -> DataFrame:
    votes = read.filter("path is not null").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("points").cast("decimal(30,3)").alias("points"))
    best = F.max(F.struct("votes", "points", "path")).alias("best")
    return votes.groupBy("host").agg(best).select("host", "best.path", "best.votes")


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each host's winning path: host, path, votes. Ties go to more running text, then the path."""
    return _winners(_read_pages(pages, url_col, html_col, ()))


def main_texts(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The main text of every page: the columns of ``keep``, then text.

    Null and empty pages and pages without text have an empty text; null URLs and URLs
    without a host vote together; rows that repeat each give a row; an empty table gives an
    empty table; other columns don't matter. Whole pages are read, whatever their length and
    however deep or badly closed their elements are.

    Pages are read once, into blocks that are written; the hosts' paths are written too, so
    that their size is known when they meet: Spark broadcasts them below its own threshold,
    and beyond it a host is spread over SALTS parts. HTML itself is never shuffled.
    """
    read = _read_pages(pages, url_col, html_col, keep)
    paths = durable(_winners(read).select("host", F.col("path").alias("winner")), "host-paths")
    salt = F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int")
    spread = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = read.withColumn("salt", salt).join(spread, ["host", "salt"], "left")
    return out.select(*[F.col(f"_keep{i}").alias(k) for i, k in enumerate(keep)], _extractor()("page", "winner").alias("text"))


def op8_main_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
