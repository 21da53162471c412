"""Main text of web pages through wrappers inferred from the pages of a host.

A page becomes a stream of tags and texts. The streams of a host's pages are aligned one after the other into a union-free regular expression, its wrapper:
adjacent runs of equal tags fold into a repeated group, equal tags meet, texts between them become text slots, a single instance meets a repeated
group of its shape, and what only one side has becomes an optional group. So a wrapper matches every page that it was inferred from.

A page's text is read through the slots. The page is aligned with the wrapper of its host in the same way, whereby the wrapper grows by what only this page has;
then each text of the page stands in a slot. What a slot is, markup and the host's pages tell together: slots inside the article (or main element) are content,
those in menus, headers, footers, sidebars, notices, adverts, forms and comments are not. Names like `header` or `discussion` on a box inside an article prove
nothing: its slot is furniture only if the host's pages hold the same text there, and neither does a name like `share-price`, of which only a part is telling. On pages without an article the slots outside
declared furniture are content, but for texts that the host's pages have in common there. Common are texts on MIN_PAGES sampled pages or more and on SHARE of them, where sampled pages that are near
copies (ALIKE of their five-word shingles) count once. A common text goes only with its whole box: if the innermost div, section or other box around it also holds a text of the page's own,
it is a sentence that articles share and stays. A page that would lose more than LOSS of its text keeps all of it. A form around MOST_OF_PAGE or more of a page's text is no furniture.

Wrappers are inferred from SAMPLE distinct pages of a host at most, those with the smallest hashes, so every host is one small task, pages with equal html count
once, and the choice does not depend on how pages are stored. All pages are read through them whole. Hosts with fewer than MIN_PAGES distinct pages have a wrapper for each
page. While they are at most SHARED wrappers of MOST bytes, counted first, wrappers are broadcast; beyond that they meet the pages by a shuffle on the host, where the at most
10,000 hosts with a ten-thousandth of all pages are salted.

Defined cases: null or empty html gives an empty text; a null url or one without host: all such pages count as one host; pages cut off anywhere
are read as far as they go; html without tags is one block; very long pages are read whole; repeated rows give repeated results; extra columns never
enter; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citewright.llm.common import cut, small_batches

SAMPLE, MIN_PAGES, SHARE, BUCKET, SHARED, MOST = 12, 3, 0.75, 500, 20_000, 32 << 20
ALIKE, LOSS, MOST_OF_PAGE = 0.8, 0.75, 0.5
#: Longest run of tokens that folds into a repeated group, nodes of a wrapper that an alignment looks ahead, and wrappers that a worker holds parsed.
PERIOD, LOOK, PARSED = 16, 64, 1000

#: Elements by their part in a page.
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes xmp textarea title svg math object canvas audio video".split())
FURNITURE = frozenset("nav footer aside button select option datalist input label fieldset dialog menu head noscript".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article main section div body html table ul ol dl td th nav aside footer header form blockquote".split())
BOXES = frozenset("html body div section article main aside nav header footer form dialog details center".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in class and id that name furniture wherever they stand; those that do outside articles; parts of words.
NAMES = frozenset("ad ads adv adbox adslot adunit menu nav topnav subnav footer cookie cookies gdpr consent notice notices popup modal newsletter subscribe signup social share sharing related recommended recommendations comment comments disqus reply replies respond form pagination pager breadcrumb breadcrumbs promo promotion sponsor sponsored paywall".split())
WEAK = frozenset("header banner side notification notifications alert overlay discussion search login toolbar widget widgets copyright legal skip skiplink masthead tags".split())
#: Words that say nothing of their own beside a telling one.
PLAIN = frozenset("box block list section wrap wrapper container area bar button buttons link links post posts article articles item items story stories widget inner content left right top bottom row col column panel module group icons icon count site page main body title heading header text message unit slot".split())
PARTS = re.compile("sidebar|cookie|commentlist|advert|footer|navbar|navigation|breadcrumb|newsletter|sponsor|popup|pagination|dropdown")
WORD = re.compile(r"[a-z0-9]+")

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Token:
    """A tag or a text. `ours`: not declared to be furniture; `weak`: in a box inside the article whose name may mean furniture; `inside`: in an article; `box`: the number of the innermost box around it; `form`: that of the outermost form around it, -1 without one."""

    __slots__ = ("box", "form", "inside", "key", "ours", "text", "weak")

    def __init__(self, key: str, text: str | None, ours: bool, weak: bool, inside: bool, box: int = 0, form: int = -1):
        self.key, self.text, self.ours, self.weak, self.inside, self.box, self.form = key, text, ours, weak, inside, box, form


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}


def furniture(tag: str, at: dict[str, str], in_article: bool) -> int:
    """2: declared furniture; 1: inside an article, named as furniture might be; 0: neither."""
    if tag in FURNITURE:
        return 2
    if tag == "header":
        return 0 if in_article else 2
    if tag in ("html", "body", "main"):
        return 0
    if at.get("role", "").lower() in ROLES or "hidden" in at or at.get("aria-hidden", "").lower() == "true" or "display:none" in at.get("style", "").replace(" ", "").lower():
        return 2
    names = f"{at.get('class', '')} {at.get('id', '')}".lower()
    if names == " ":
        return 0
    telling = lambda w: w in NAMES or PARTS.search(w)
    words = WORD.findall(names)
    if in_article:
        doubt = 0
        for name in names.split():
            ws = [w for w in WORD.findall(name) if not w.isdigit()]
            if any(map(telling, ws)):
                if all(telling(w) or w in WEAK or w in PLAIN for w in ws):
                    return 2
                doubt = 1
        return 1 if doubt or any(w in WEAK for w in words) else 0
    return 2 if PARTS.search(names) or any(w in NAMES or w in WEAK for w in words) else 0


def tokens(html: str) -> list[Token]:
    """The stream of a page. Texts are the pieces between tags as written, with references decoded."""
    out: list[Token] = []
    stack: list[tuple[str, int, bool, int, int]] = []  # tag, what it made of its content, whether it opened an article; the box and the form around it
    off = weak = inside = 0  # open furniture and open weak boxes since the innermost article; open articles
    saved: list[tuple[int, bool]] = []
    hidden = False  # the article itself stands in furniture
    box, boxes, form, forms = 0, 0, -1, 0
    at, end = 0, len(html)

    def close(n: int) -> None:
        nonlocal off, weak, inside, hidden, box, form
        while len(stack) > n:
            _, chrome, article, box, form = stack.pop()
            off -= chrome == 2
            weak -= chrome == 1
            if article:
                inside -= 1
                off, hidden = saved.pop()

    def text(piece: str) -> None:
        piece = unescape(piece)
        if piece:
            out.append(Token("#", piece, off == 0 and not hidden, weak > 0, inside > 0, box, form))

    def mark(key: str) -> None:
        out.append(Token(key, None, off == 0, weak > 0, inside > 0))

    for m in TAG.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            if tag in BLOCK:
                mark("/" + tag)
            continue
        raw = m[3] or m[6] or ""
        if tag in CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES[tag]:
                    close(i)
                    break
                if stack[i][0] in SCOPE:
                    break
        values = attributes(raw) if raw.strip() else {}
        if tag in RAW:
            stop = re.compile(f"</{tag}\\b[^>]*(?:>|\\Z)", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        article = tag in ("article", "main") or values.get("role", "").lower() in ("main", "article") or values.get("itemprop", "").lower() == "articlebody"
        chrome = furniture(tag, values, inside > 0)
        if tag in BLOCK:
            mark(tag + ("." + values["class"] if "class" in values else ""))
        if tag in VOID or raw.endswith("/") and tag not in BLOCK:
            continue
        opens = article and not inside and chrome < 2
        stack.append((tag, 0 if opens else chrome, opens, box, form))
        if opens:
            saved.append((off, hidden))
            hidden = off > 0
            off = 0
            inside += 1
            form = -1
        else:
            off += chrome == 2
            weak += chrome == 1
        if tag in BOXES:
            boxes += 1
            box = boxes
        if tag == "form" and form < 0:
            form, forms = forms, forms + 1
    if at < end:
        text(html[at:])
    if forms:
        held, whole = [0] * forms, 0
        for t in out:
            if t.text and t.ours:
                whole += (n := len(t.text.strip()))
                if t.form >= 0:
                    held[t.form] += n
        for t in out:
            if t.form >= 0 and held[t.form] < MOST_OF_PAGE * whole:
                t.ours = False
    return out


# ---- wrappers ----------------------------------------------------------------------------------------------------------
# A node is ["t", key] for a tag, ["x", key, slot] for a text slot, ["?", nodes] for an optional group and ["+", nodes] for a repeated one.


class Slot:
    """A text slot. at: the tokens of one page that stand in it; seen: the pages that have each text there; common: texts that the host's pages share there."""

    __slots__ = ("at", "common", "seen")

    def __init__(self, at: list[int] | None = None, seen: dict[int, set[int]] | None = None, common: frozenset[int] = frozenset()):
        self.at, self.seen, self.common = at or [], seen or {}, common

    def add(self, other: Slot) -> Slot:
        self.at += other.at
        for text, pages in other.seen.items():
            self.seen.setdefault(text, set()).update(pages)
        return self


def key(node: list) -> str:
    return node[1] if node[0] in "tx" else node[0] + (key(node[1][0]) if node[1] else "")


def shape(nodes: list[list]) -> list[str]:
    return [key(n) for n in nodes]


def merge(a: list, b: list, meet) -> list:
    """Of two nodes with the same key: what matches both."""
    if a[0] in "+?":
        return [a[0], align(a[1], b[1], meet)]
    return a if a[0] == "t" else ["x", a[1], meet(a[2], b[2])]


def digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(text.split()).encode("utf-8", "surrogatepass"))


def fold(stream: list[Token], page: int | None = None) -> list[list]:
    """Nodes of a page. Texts side by side are one slot; adjacent runs of one shape, up to PERIOD tokens long, become a repeated group. page: its number, to note what it has."""
    out: list[list] = []
    keys: list[str] = []
    meet = Slot.add
    for i, t in enumerate(stream):
        if t.key == "#":
            if not t.text or t.text.isspace():
                continue
            k = f"#{t.inside:d}{t.ours:d}{t.weak:d}"
            slot = Slot([i], None if page is None else {digest(t.text): {page}})
            if keys and keys[-1] == k:
                out[-1][2].add(slot)
            else:
                out.append(["x", k, slot])
                keys.append(k)
            continue
        out.append(["t", t.key])
        keys.append(t.key)
        if t.key[0] != "/":
            continue
        for n in range(2, PERIOD + 1):
            if len(out) <= n:
                break
            if keys[-n - 1] == "+" + keys[-n] and shape(out[-n - 1][1]) == keys[-n:]:
                group = out[-n - 1]
                group[1] = [merge(a, b, meet) for a, b in zip(group[1], out[-n:])]
                del out[-n:], keys[-n:]
                break
            if len(out) >= 2 * n and keys[-n - 1] == t.key and keys[-2 * n : -n] == keys[-n:]:
                body = [merge(a, b, meet) for a, b in zip(out[-2 * n : -n], out[-n:])]
                del out[-2 * n :], keys[-2 * n :]
                out.append(["+", body])
                keys.append("+" + key(body[0]))
                break
    return out


def flatten(nodes: list[list]) -> list[tuple[list, int | None]]:
    """Nodes with optional groups opened: (node, number of its group)."""
    return [pair for g, n in enumerate(nodes) for pair in ([(x, g) for x in n[1]] if n[0] == "?" else [(n, None)])]


def align(a: list[list], b: list[list], meet) -> list[list]:
    """A wrapper that matches what either matches. meet(slot of a, slot of b) is called for slots that meet and gives the common one."""
    fa, fb = flatten(a), flatten(b)
    ka, kb = [key(n) for n, _ in fa], [key(n) for n, _ in fb]
    where: dict[str, list[int]] = {}
    for j, k in enumerate(kb):
        where.setdefault(k, []).append(j)
    out: list[list] = []
    run: list[list] = []
    origin = None

    def put(node: list, of=None) -> None:
        """of: where an optional node comes from; neighbours with one origin stay a group."""
        nonlocal run, origin
        if run and of != origin:
            out.append(["?", run])
            run = []
        origin = of
        (out if of is None else run).append(node)

    i = j = 0
    while i < len(ka) and j < len(kb):
        if ka[i] == kb[j]:
            (x, g), (y, h) = fa[i], fb[j]
            put(merge(x, y, meet), None if g is None and h is None else ("both", g, h))
            i, j = i + 1, j + 1
            continue
        grown = repeat(fa, ka, i, fb, kb, j, meet)
        if grown:
            put(grown[0], None if grown[3] else ("both", i, j))
            i, j = i + grown[1], j + grown[2]
            continue
        best = None
        for di in range(min(len(ka) - i, LOOK)):
            if best and di >= best[0] + best[1]:
                break
            places = where.get(ka[i + di], ())
            at = bisect_left(places, j)
            if at < len(places) and (best is None or di + places[at] - j < best[0] + best[1]):
                best = di, places[at] - j
        di, dj = best or (len(ka) - i, len(kb) - j)
        for x, g in fa[i : i + di]:
            put(x, ("a", g))
        for x, g in fb[j : j + dj]:
            put(x, ("b", g))
        i, j = i + di, j + dj
    for x, g in fa[i:]:
        put(x, ("a", g))
    for x, g in fb[j:]:
        put(x, ("b", g))
    if run:
        out.append(["?", run])
    return out


def repeat(a, ka, i: int, b, kb, j: int, meet):
    """A repeated group on one side against one instance of it on the other: (group, nodes used of a, of b, whether all are required), or none."""
    for one, k1, p, two, k2, q, turned in ((a, ka, i, b, kb, j, False), (b, kb, j, a, ka, i, True)):
        node, group = one[p]
        if node[0] == "+" and k1[p] == "+" + k2[q]:
            body = shape(node[1])
            single = two[q : q + len(body)]
            if k2[q : q + len(body)] == body and len({g for _, g in single}) == 1:  # in part optional, it is no instance
                pairs = [(x, y) if turned else (y, x) for y, (x, _) in zip(node[1], single)]
                made = ["+", [merge(x, y, meet) for x, y in pairs]]
                needed = group is None and single[0][1] is None
                return (made, len(body), 1, needed) if turned else (made, 1, len(body), needed)
    return None


def shingles(stream: list[Token]) -> set[int]:
    """Hashes of the five-word runs of a page's texts outside declared furniture (of all of them as one, if they have fewer words)."""
    ws = " ".join([t.text for t in stream if t.text and t.ours]).split()
    return {hash(tuple(ws[i : i + 5])) for i in range(max(1, len(ws) - 4))}


def different(pages: list[list[Token]]) -> list[list[Token]]:
    """Pages of which no two are near copies: the first of each kind."""
    kept: list[tuple[list[Token], set[int]]] = []
    for p in pages:
        mine = shingles(p)
        if all(len(mine & other) < ALIKE * len(mine | other) for _, other in kept):
            kept.append((p, mine))
    return [p for p, _ in kept]


def infer(pages: list[list[Token]]) -> list[list] | None:
    """The wrapper of a host, or none if there are too few different pages to tell what repeats."""
    pages = different(pages)
    if len(pages) < MIN_PAGES:
        return None
    wrapper = fold(pages[0], 0)
    for n, p in enumerate(pages[1:], 1):
        wrapper = align(wrapper, fold(p, n), Slot.add)
    least = max(MIN_PAGES, SHARE * len(pages))

    def settle(nodes: list[list]) -> list[list]:
        out = []
        for n in nodes:
            if n[0] == "x":
                n = ["x", n[1], Slot(common=frozenset(t for t, had in n[2].seen.items() if len(had) >= least))]
            out.append([n[0], settle(n[1])] if n[0] in "+?" else n)
        return out

    return settle(wrapper)


def dump(nodes: list[list]) -> str:
    """A wrapper as text."""
    return json.dumps(nodes, default=lambda slot: sorted(slot.common), separators=(",", ":"))


def load(text: str) -> list[list]:
    def build(nodes):
        return [["x", n[1], Slot(common=frozenset(n[2]))] if n[0] == "x" else [n[0], build(n[1])] if n[0] in "+?" else n for n in nodes]

    return build(json.loads(text))


# ---- texts -------------------------------------------------------------------------------------------------------------


def text_of(stream: list[Token], wrapper: list[list] | None) -> str:
    """The text of a page through the slots of its host's wrapper, grown by what only the page has; None: through slots of its own."""
    slot_of: dict[int, Slot] = {}

    def meet(known: Slot, mine: Slot) -> Slot:
        slot_of.update(dict.fromkeys(mine.at, known))
        return known

    own = fold(stream)
    grown = align(wrapper, own, meet) if wrapper else own
    stack = list(grown)
    while stack:  # slots that only the page has
        n = stack.pop()
        if n[0] == "x":
            slot_of.update((i, n[2]) for i in n[2].at)
        elif n[0] in "+?":
            stack += n[1]
    articles = any(stream[i].inside and stream[i].ours for i in slot_of)
    # an article that stands in furniture (a page whose menu was never closed) is better than nothing
    lost = not articles and any(stream[i].inside for i in slot_of)

    def content(i: int) -> bool:
        t = stream[i]
        return t.inside if lost else t.ours and (t.inside or not articles)

    kept = {i for i in slot_of if content(i)}
    if not lost:
        common = {i for i in kept if (stream[i].weak or not articles) and digest(stream[i].text) in slot_of[i].common}
        own = {stream[i].box for i in kept - common}
        gone = {i for i in common if stream[i].box not in own}
        length = lambda some: sum(len(stream[i].text.strip()) for i in some)
        if length(gone) <= LOSS * length(kept):
            kept -= gone
    if not kept:
        kept = {i for i in slot_of if stream[i].ours}
    blocks, run = [], []
    for i, t in enumerate(stream):
        if t.key == "#":
            if i in kept or i not in slot_of:  # the latter are blanks
                run.append(t.text)
        elif run:
            blocks.append(" ".join("".join(run).split()))
            run = []
    blocks.append(" ".join("".join(run).split()))
    return " ".join(b for b in blocks if b)


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def wrappers(rows: DataFrame) -> DataFrame:
    """host, wrapper (as text) of each host with MIN_PAGES distinct pages or more. rows: host, html."""
    hashed = rows.select("host", "html", F.xxhash64("html").alias("h"))
    chosen = hashed.select("host", "h").distinct()
    for part in (F.pmod("h", F.lit(16)), F.lit(0)):  # of each sixteenth of a host's pages, then of the host; each task keeps SAMPLE rows before it shuffles them
        first = Window.partitionBy("host", "part").orderBy("h")
        chosen = chosen.withColumn("part", part).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= SAMPLE).select("host", "h")
    enough = chosen.groupBy("host").agg(F.collect_list("h").alias("hs")).filter(F.size("hs") >= MIN_PAGES)
    chosen = cut(enough.select("host", F.explode("hs").alias("h")))
    few = chosen.count() <= SHARED * SAMPLE
    pages = hashed.join(F.broadcast(chosen) if few else chosen, ["host", "h"], "left_semi").groupBy("host", "h").agg(F.first("html").alias("html"))
    ordered = pages.repartition("host").sortWithinPartitions("host", "h").select("host", "html")

    def run(batches):
        host, held = None, []

        def close():
            made = infer(held)
            got = [(host, dump(made))] if made else []
            return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.string()) for k in range(2)], names=["host", "wrapper"])

        for b in batches:
            for h, html in zip(*(c.to_pylist() for c in b.columns)):
                if h != host:
                    if held:
                        yield close()
                    host, held = h, []
                held.append(tokens(html or ""))
        if held:
            yield close()

    return ordered.mapInArrow(run, "host string, wrapper string")


class Wrappers(dict):
    """host -> wrapper, parsed when it is first asked for."""

    def __init__(self, texts: dict[str, str]):
        super().__init__()
        self.texts = texts

    def __missing__(self, host: str):
        if len(self) >= PARSED:
            self.clear()
        text = self.texts.get(host)
        made = self[host] = load(text) if text else None
        return made


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    small_batches(spark, rows=500)
    kind = pages.schema["page_id"].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), HOST, 1))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    made = cut(wrappers(rows))
    size = made.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("wrapper")), F.lit(0)).alias("b")).first()
    schema = f"page_id {kind}, url string, text string, n_chars long"

    def batch(ids, urls, texts):
        return pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if size["n"] <= SHARED and size["b"] <= MOST:
        shared = spark.sparkContext.broadcast({r["host"]: r["wrapper"] for r in made.collect()})

        def run(batches):
            known = Wrappers(shared.value)
            for b in batches:
                yield batch(b.column(0), b.column(1), [text_of(tokens(html or ""), known[h]) for html, h in zip(b.column(2).to_pylist(), b.column(3).to_pylist())])

        return rows.mapInArrow(run, schema)
    counts = cut(rows.groupBy("host").agg(F.count("*").alias("c")))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()["n"]
    hot = cut(counts.filter(F.col("c") > max(BUCKET, total // 10_000)).select("host", F.ceil(F.col("c") / BUCKET).alias("buckets")))  # at most 10,000 rows
    buckets = F.coalesce(F.col("buckets"), F.lit(1)).cast("long")
    salted = rows.join(F.broadcast(hot), "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), buckets)).select("host", "salt", F.lit(1).alias("step"), "page_id", "url", "html")
    copies = made.join(F.broadcast(hot), "host", "left").select("host", F.explode(F.sequence(F.lit(0).cast("long"), buckets - 1)).alias("salt"), F.lit(0).alias("step"), F.lit(None).cast(kind).alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("wrapper").alias("html"))
    # a wrapper comes before the pages that it reads
    met = salted.unionByName(copies).repartition("host", "salt").sortWithinPartitions("host", "salt", "step").select("page_id", "url", "html", "host", "step")

    def follow(batches):
        host, wrapper = None, None
        for b in batches:
            texts, pages_ = [], []
            for n, (html, h, step) in enumerate(zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))):
                if h != host:
                    host, wrapper = h, None
                if step == 0:
                    wrapper = load(html)
                    continue
                pages_.append(n)
                texts.append(text_of(tokens(html or ""), wrapper))
            at = pa.array(pages_, pa.int64())
            yield batch(b.column(0).take(at), b.column(1).take(at), texts)

    return met.mapInArrow(follow, schema)
