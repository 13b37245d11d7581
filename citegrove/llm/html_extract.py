"""HTML extraction by site style trees: pages of one host merge into a tree of styles, entropies tell content from
presentation, and branches of low importance leave every page."""

from __future__ import annotations

import html
import re
from collections import Counter
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrove.llm.common import stored

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "br", "param"}
_BLOCK = set("html head body article section main nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody "
             "tfoot tr td th caption blockquote pre form fieldset figure figcaption address details summary dialog template select "
             "option button svg canvas object hgroup menu center legend datalist audio video map".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}}
_UNDER = {"ul", "ol", "dl", "table", "select", "article", "section", "div", "body", "main", "nav", "aside", "blockquote", "menu"}
_PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
# elements that are never an article's text, and words of class, id or role that make it less likely
_ROLES = {"head", "nav", "aside", "footer", "form", "template", "select", "option", "button", "svg", "canvas", "object", "menu",
          "dialog", "datalist", "audio", "video", "map"}
_WORDS = set("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion nav navbar navigation "
             "menu breadcrumb breadcrumbs sidebar aside footer masthead comment comments disqus respond cookie cookies consent notice "
             "popup modal overlay newsletter subscribe signup social share sharing related recommended recommendations widget pager "
             "pagination toolbar login search complementary contentinfo legal copyright skip".split())
_PHRASE = re.compile(r"[.!?;:,|•·\n]+\s*")
_ids: dict[tuple[int, str], int] = {}
_styles: dict[tuple[str, str], tuple[str, int]] = {}
ROOT, ALL_HOSTS = 0, 0
BY_TAG, BY_WORD = 1, 2


def number(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def style_of(tag: str, attributes: str) -> tuple[str, int]:
    """The style of an element (tag, class, id and role without digits) and what it names: BY_TAG if the element is no article
    text, BY_WORD if its attributes speak against it, else 0."""
    key = (tag, attributes)
    if key not in _styles:
        if len(_styles) > 50_000:
            _styles.clear()
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _NAMED.finditer(attributes)}
        tokens = {w for v in found.values() for w in re.split(r"[^a-z]+", v) if w}
        style = tag + "".join(f"|{k}={re.sub(r'[0-9]+', '#', ' '.join(sorted(v.split())))}" for k, v in sorted(found.items()) if v)
        by_word = BY_WORD if tokens & _WORDS and tag not in ("html", "body", "article", "main") else 0
        _styles[key] = style, BY_TAG if tag in _ROLES else by_word
    return _styles[key]


def child(path: int, style: str) -> int:
    key = (path, style)
    if key not in _ids:
        if len(_ids) > 200_000:
            _ids.clear()
        _ids[key] = number(f"{path}/{style}")
    return _ids[key]


def parse(page: str | None):
    """(blocks, elements) of a page. blocks: (path, named, text) in page order, where path numbers the styles from the root
    and named tells what the enclosing elements name (0, BY_WORD, or BY_TAG if one does); text has its references decoded and its white space made
    single blanks. elements: (path, parent, its children's paths in order, without direct repetition, whether it is a paragraph
    or heading, named)."""
    blocks: list[tuple[int, int, str]] = []
    elements: list[tuple[int, int, tuple, bool, int]] = []
    stack: list[tuple[str, int, int, list]] = [("", ROOT, 0, [])]
    words: list[str] = []

    def flush():
        text = " ".join(html.unescape("".join(words)).split())
        words.clear()
        if text:
            blocks.append((stack[-1][1], stack[-1][2], text))

    def close():
        tag, path, named, children = stack.pop()
        elements.append((path, stack[-1][1], tuple(children), tag in _PROSE, named))

    page, at = page or "", 0
    while True:
        start = page.find("<", at)
        if start < 0:
            words.append(page[at:])
            break
        words.append(page[at:start])
        m = _TAG.match(page, start)
        if not m:
            words.append("<")
            at = start + 1
            continue
        at = m.end()
        end_tag, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in _RAW:
            if not end_tag and not attributes.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if tag in ("br", "hr"):
            words.append(" ")
        if tag not in _BLOCK or tag in _VOID:
            continue
        flush()
        if end_tag:
            if any(x[0] == tag for x in stack[1:]):
                while stack[-1][0] != tag:
                    close()
                close()
            continue
        while len(stack) > 1 and (stack[-1][0] == "p" or stack[-1][0] in _CLOSES.get(tag, ())):
            close()
        if tag in _CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in _UNDER:
                    break
                if stack[i][0] in _CLOSES[tag]:
                    while len(stack) > i:
                        close()
                    break
        style, named = style_of(tag, attributes)
        if tag == "header" and not any(x[0] in ("article", "main", "section") for x in stack):
            named = BY_TAG
        path = child(stack[-1][1], style)
        if not stack[-1][3] or stack[-1][3][-1] != path:
            stack[-1][3].append(path)
        outer = stack[-1][2]
        stack.append((tag, path, BY_TAG if BY_TAG in (named, outer) else named or outer, []))
    flush()
    while len(stack) > 1:
        close()
    return blocks, elements


def features(blocks, elements):
    """What a page adds to its tree: (path, parent, kind, feature, weight). Content features of a node are its short phrases or
    its long blocks whole; its presentation feature is the order of its children's styles; kind w tells what it is named."""
    found: Counter = Counter()
    size: Counter = Counter()
    for path, _, text in blocks:
        size[path] += len(text)
        for phrase in (_PHRASE.split(text) if len(text) <= 160 else [text]):
            if phrase.strip():
                found[path, "c", number(phrase.strip())] += 1
    parents = {path: parent for path, parent, *_ in elements}
    prose = {path for path, _, _, is_prose, _ in elements if is_prose}
    for path, _, children, _, named in elements:
        if named:
            found[path, "w", named] = 1
        if children:
            found[path, "s", number(repr(children))] += 1
    for path in {*parents, *size}:
        found[path, "p", int(path in prose)] += size[path]
    return [(path, parents.get(path, ROOT), kind, feature, n) for (path, kind, feature), n in found.items()]


def host_of(url: str | None) -> str:
    m = re.match(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return re.sub(r"^www\.", "", m[1].lower()) if m else ""


def tree_counts(pages: DataFrame, url: str, page: str) -> DataFrame:
    """(host, path, parent, kind, feature, pages, n): the merged trees of all hosts, combined in each task first."""
    def count(batches):
        for batch in batches:
            total: dict[tuple, list[int]] = {}
            for u, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host = number("host " + host_of(u))
                for path, parent, kind, feature, n in features(*parse(p)):
                    entry = total.setdefault((host, path, parent, kind, feature), [0, 0])
                    entry[0] += 1
                    entry[1] += n
            keys = list(zip(*total, strict=True)) or [()] * 5
            sums = list(zip(*total.values(), strict=True)) or [()] * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.string() if i == 3 else pa.int64()) for i, x in enumerate([*keys, *sums])],
                ["host", "path", "parent", "kind", "feature", "pages", "n"])
    rows = pages.select(url, page).mapInArrow(
        count, "host long, path long, parent long, kind string, feature long, pages long, n long")
    return rows.groupBy("host", "path", "parent", "kind", "feature").agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"))


def node_entropies(counts: DataFrame) -> DataFrame:
    """(host, path, parent, prose, named, m, size, content, presentation) of every style node. m: its pages; size: characters of its text.
    A content feature seen on k of m pages has entropy log k / log m; content is one less the mean entropy over all
    occurrences. presentation is the entropy, to base m, of the children's styles."""
    k = F.col("pages")
    node = counts.groupBy("host", "path", "parent").agg(
        F.max(F.when(F.col("kind") == "p", F.col("feature"))).alias("prose"), F.max(F.when(F.col("kind") == "p", k)).alias("m"), F.max(F.when(F.col("kind") == "p", F.col("n"))).alias("size"),
        F.coalesce(F.max(F.when(F.col("kind") == "w", F.col("feature"))), F.lit(0).cast("long")).alias("named"),
        F.sum(F.when(F.col("kind") == "c", k * F.log(k))).alias("c_log"), F.sum(F.when(F.col("kind") == "c", k)).alias("c"),
        F.sum(F.when(F.col("kind") == "s", F.col("n") * F.log("n"))).alias("s_log"), F.sum(F.when(F.col("kind") == "s", F.col("n"))).alias("s"))
    many = F.col("m") > 1
    return node.select("host", "path", "parent", "prose", "named", "m", "size",
                       F.when(F.col("c") > 0, F.when(many, 1 - F.col("c_log") / F.col("c") / F.log("m")).otherwise(1.0)).alias("content"),
                       F.when(F.col("s") > 0, F.when(many, (F.log("s") - F.col("s_log") / F.col("s")) / F.log("m")).otherwise(1.0)).alias("presentation"))


def noisy_branches(nodes: pd.DataFrame, threshold: float, decay: float) -> list[int]:
    """Paths of one host's tree whose whole branch has low importance.

    A node's composite importance mixes its presentation with the weighted importance of its children (and of its own text),
    the presentation by 1 - decay^l for l children. A branch is noise if all its nodes stay under the threshold, but the
    limit never passes three quarters of the best importance among nodes that hold a tenth of the host's text; paragraphs and
    headings beside such a node that is no noise stay with it. A branch that is named by a word counts in proportion to its share
    of the host's text, up to one half, and is held to the whole threshold."""
    info = {r.path: r for r in nodes.itertuples()}
    below: dict[int, list[int]] = {}
    for r in info.values():
        below.setdefault(r.parent, []).append(r.path)
    total = sum(r.size for r in info.values())
    limit = min(threshold, 0.75 * max((r.content for r in info.values() if r.content == r.content and r.size * 10 >= total), default=1.0))
    depth, order = [p for p in info if info[p].parent not in info], []
    while depth:
        order.append(depth.pop())
        depth += below.get(order[-1], [])
    held = {p: r.size for p, r in info.items()}
    for path in reversed(order):
        if info[path].parent in held:
            held[info[path].parent] += held[path]
    weight: dict[int, float] = {}
    for path in order:
        if info[path].named == BY_WORD:
            weight[path] = weight[info[path].parent] if info[path].parent in weight else min(1.0, 2 * held[path] / max(total, 1))
    composite: dict[int, float] = {}
    noise: dict[int, bool] = {}
    for path in reversed(order):
        r, parts = info[path], below.get(path, [])
        values = [(composite[c], info[c].m) for c in parts] + ([(r.content, r.m)] if r.content == r.content else [])
        share = decay ** len(values)
        inner = sum(v * w for v, w in values) / sum(w for _, w in values) if values else 0.0
        composite[path] = (1 - share) * (r.presentation if r.presentation == r.presentation else inner) + share * inner
        own = r.content if r.content == r.content else 0.0
        most = max(own, composite[path] if parts else own)
        noise[path] = all(noise[c] for c in parts) and (most * weight[path] < threshold if path in weight else most < limit)
    main = {info[p].parent for p, x in noise.items() if not x and info[p].prose and info[p].size * 10 >= total}
    return sorted(p for p, x in noise.items() if x and not (info[p].prose and info[p].parent in main))


def style_trees(pages: DataFrame, url: str = "url", page: str = "html", threshold: float = 0.6, decay: float = 0.9) -> DataFrame:
    """(host, noise): the noisy paths of each host. A node's content importance is the lower of its host's and of all hosts'
    together, so that small hosts learn from the others. Only style nodes are grouped by host, never pages."""
    counts = stored(tree_counts(pages, url, page), "style-trees")
    own = node_entropies(counts)
    common = node_entropies(counts.groupBy("path", "parent", "kind", "feature").agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"))
                            .withColumn("host", F.lit(ALL_HOSTS).cast("long")))
    both = own.join(common.select("path", F.col("content").alias("c2")), "path").withColumn("content", F.least("content", "c2")).drop("c2")

    def decide(key, nodes: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "noise": [noisy_branches(nodes, threshold, decay)]})

    return both.groupBy("host").applyInPandas(decide, "host long, noise array<long>")


def main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html", broadcast_hosts: int = 20_000) -> DataFrame:
    """(id_col, url, text) of every row: the text of its main branches.

    Dropped are branches the style tree of the page's host finds noisy, among them most that a class, id or role names as menu,
    advert, notice or comments, and elements like nav, header, footer, aside and form; scripts, styles and markup are never text. References are decoded,
    white space within a block is one blank, blocks are joined in page order by one blank. Null or empty html gives an empty
    text; a null url, or one without host, belongs to the host of that kind; repeated rows are read each; an empty table
    gives no rows; other columns are ignored. Trees of at most broadcast_hosts hosts travel to all tasks; more are joined by
    host, where Spark splits a large host's pages."""
    trees = stored(style_trees(pages, url, page), "noise")
    few = trees.count() <= broadcast_hosts
    types = dict(pages.dtypes)
    host = F.udf(lambda u: number("host " + host_of(u)), "long")
    rows = pages.select(id_col, url, page)
    if few:
        known = pages.sparkSession.sparkContext.broadcast({r.host: frozenset(r.noise) for r in trees.collect()})
    else:
        rows = rows.withColumn("_host", host(url)).join(trees, F.col("_host") == F.col("host"), "left").drop("_host", "host")

    def read(batches):
        for batch in batches:
            texts = []
            noises = None if few else batch.column(3).to_pylist()
            for i, (u, p) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                noise = known.value.get(number("host " + host_of(u)), ()) if few else set(noises[i] or ())
                texts.append(" ".join(t for path, named, t in parse(p)[0] if named != BY_TAG and path not in noise))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [id_col, url, "text"])

    return rows.mapInArrow(read, f"`{id_col}` {types[id_col]}, `{url}` {types[url]}, text string")
