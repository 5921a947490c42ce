"""Main text of web pages by deducing the template that pages of one host share.

Tokens of a page are the opening and closing tags of its block elements, told
apart by their path from the root, and its runs of text, told apart by their
path and content.  Tokens with the same occurrence vector (how often each page
of the host holds them) form an equivalence class; a vector is kept as a sum of
hashes of (page, count), so it is aggregated like a count and never listed.
Classes whose tokens come in one order on every page, and whose occurrences lie
in the same gap of the class around them, are valid and nest into the host's
template.  Its gaps are the slots.  The element of the template that holds the
variable text outside of flagged elements is the container; the text of its
slots is the main text.  Runs that belong to the template are left out, unless
the container is an article or main element, whose text is all kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from partsmith.llm.page_blocks import ARTICLE, CLOSE, OPEN, RUN, Page
from partsmith.llm.words import mix
from partsmith.session import stage

#: a token belongs to a template if at least so many pages of the host hold it, and this share of them
MIN_PAGES = 4
MIN_SHARE = 0.2
#: an element holds the main text if it has this share of the variable text
HOLDS = 0.9
_EVERY_PAGE = 0  # a token that each page holds once
_PART = 31  # vectors are kept as two sums of so many bits, which stay in 64 bits up to 2**32 pages

_TOKENS = "host string, print long, tokens array<long>, kinds array<tinyint>, sizes array<int>"
_VECTORS = "host string, token long, kind tinyint, v1 long, v2 long, pages long"
_FACTS = "host string, token long, kind tinyint, shape long, size long, main int, depth int, times int"
_TEMPLATE = "container array<long>, fixed array<long>, is_article boolean"


def host_of(url: Column) -> Column:
    """Host of a URL in small letters without port and user; '' for null or none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _parsed(batch: pa.RecordBatch) -> Iterator[Page]:
    for html in batch.column("html"):
        yield Page(html.as_py())


def _tokenise(batches):
    for batch in batches:
        prints, tokens, kinds, sizes = [], [], [], []
        for key, page in zip(batch.column("print").to_pylist(), _parsed(batch)):
            prints.append(key)
            tokens.append(np.array(page.tokens, np.int64))
            kinds.append(np.array(page.kinds, np.int8))
            sizes.append(np.array(page.sizes, np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), pa.array(prints, pa.int64()), pa.array(tokens, pa.list_(pa.int64())),
             pa.array(kinds, pa.list_(pa.int8())), pa.array(sizes, pa.list_(pa.int32()))],
            names=["host", "print", "tokens", "kinds", "sizes"])


def _vectors(batches):
    """One row per page and distinct token: what the page adds to the token's occurrence vector."""
    mask = np.uint64((1 << _PART) - 1)
    for batch in batches:
        hosts, out = [], {"token": [], "kind": [], "v1": [], "v2": []}
        for host, key, tokens, kinds in zip(batch.column("host").to_pylist(), batch.column("print").to_pylist(),
                                            batch.column("tokens").to_pylist(), batch.column("kinds").to_pylist()):
            distinct, first, count = np.unique(np.array([_EVERY_PAGE, *tokens], np.int64), return_index=True, return_counts=True)
            h = mix(np.uint64(key & 0xFFFFFFFFFFFFFFFF) ^ mix(count.astype(np.uint64)))
            hosts += [host] * len(distinct)
            out["token"].append(distinct)
            out["kind"].append(np.array([OPEN, *kinds], np.int8)[first])
            out["v1"].append((h & mask).astype(np.int64))
            out["v2"].append((h >> np.uint64(64 - _PART)).astype(np.int64))
        if hosts:
            columns = {name: np.concatenate(parts) for name, parts in out.items()}
            columns["pages"] = np.ones(len(hosts), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *map(pa.array, columns.values())], names=["host", *columns])


def shapes(tokens: list[int], classes: dict[int, int]) -> dict[int, int]:
    """Per class on this page a hash of the order of its tokens and of the gap around each of its occurrences.

    Two pages on which a class is ordered and nested alike give the same
    hash.  An occurrence runs from the class's first token to its last; its
    gap is the token before it of the class that is open around it.  A class
    whose tokens do not follow each other, or whose occurrences cross those
    of a larger class, gets 0, which makes it invalid for the host.
    """
    order: dict[int, list[int]] = {}
    for t in tokens:
        c = classes.get(t)
        if c is not None and t not in order.setdefault(c, []):
            order[c].append(t)
    place = {t: i for found in order.values() for i, t in enumerate(found)}
    gaps: dict[int, set[tuple[int, int]]] = {c: set() for c in order}
    broken: set[int] = set()
    open_: list[list[int]] = []  # class, tokens seen in this occurrence, its last token
    for t in tokens:
        c = classes.get(t)
        if c is None:
            continue
        at = place[t]
        if at == 0:
            around = open_[-1] if open_ else None
            gaps[c].add((around[0], around[2]) if around else (0, 0))
            open_.append([c, 1, t])
        else:
            mine = next((d for d in range(len(open_) - 1, -1, -1) if open_[d][0] == c and open_[d][1] == at), -1)
            if mine < 0:
                broken.add(c)
                continue
            open_[mine][1:] = [at + 1, t]
            for inner, *_ in open_[mine + 1:]:  # the spans cross: the smaller class is none of the template
                broken.add(inner if len(order[inner]) <= len(order[c]) else c)
        while open_ and open_[-1][1] == len(order[open_[-1][0]]):
            open_.pop()
    broken |= {c for c, *_ in open_}
    out = {}
    for c, found in order.items():
        text = repr((found, sorted(gaps[c])))
        out[c] = 0 if c in broken else xxhash.xxh64_intdigest(text) >> 1 | 1
    return out


def _facts(batches):
    """Per page and template token: the shape of its class, and for elements the variable text below it."""
    for batch in batches:
        rows: list[tuple] = []
        known: dict[str, dict[int, int]] = {}
        lists = (batch.column(c).to_pylist() for c in ("host", "tokens", "kinds", "sizes"))
        for host, tokens, kinds, sizes, template in zip(*lists, batch.column("template")):
            if host not in known:
                known[host] = {t["token"]: t["class"] for t in template.as_py()}
            classes = known[host]
            shape = shapes(tokens, classes)
            below: dict[int, list[int]] = {}
            stack: list[int] = []
            main = set()
            for t, kind, size in zip(tokens, kinds, sizes):
                if kind == RUN:
                    if size and t not in classes:  # not the template's own text
                        for e in set(stack):
                            below[e][0] += size
                elif kind == CLOSE:
                    stack.pop()
                else:
                    stack.append(t)
                    below.setdefault(t, [0, len(stack)])
                    if kind == ARTICLE:
                        main.add(t)
            kind_of, times = dict(zip(tokens, kinds)), Counter(tokens)
            for t in kind_of:
                if t in classes:
                    size, depth = below.get(t, (0, 0))
                    rows.append((host, t, kind_of[t], shape[classes[t]], size, int(t in main), depth, times[t]))
        if rows:
            host, token, kind, shape, size, main, depth, times = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(host, pa.string()), pa.array(token, pa.int64()), pa.array(kind, pa.int8()), pa.array(shape, pa.int64()),
                 pa.array(size, pa.int64()), pa.array(main, pa.int32()), pa.array(depth, pa.int32()), pa.array(times, pa.int32())],
                names=["host", "token", "kind", "shape", "size", "main", "depth", "times"])


def choose(tokens: list[dict]) -> dict:
    """Container and template text of a host from its valid tokens (token, kind, class, size, main, depth, times).

    Among article and main elements the one with most variable text; else the
    deepest element that a page holds once and that has ``HOLDS`` of the
    text of the largest.  Elements in classes of one token, whose
    closing tag is elsewhere, are no part of a template.
    """
    members: dict[int, int] = {}
    for t in tokens:
        members[t["class"]] = members.get(t["class"], 0) + 1
    tokens = [t for t in tokens if members[t["class"]] > 1]
    elements = [t for t in tokens if t["kind"] in (OPEN, ARTICLE) and t["size"] > 0]
    articles = [t for t in elements if t["main"]]
    if articles:
        return {"container": [max(articles, key=lambda t: (t["size"], -t["depth"], t["token"]))["token"]], "fixed": [], "is_article": True}
    fixed = sorted(t["token"] for t in tokens if t["kind"] == RUN)
    if not elements:
        return {"container": [], "fixed": fixed, "is_article": False}
    most = max(t["size"] for t in elements)
    chain = [t for t in elements if t["size"] >= HOLDS * most and t["times"] == 1]
    if not chain:
        return {"container": [], "fixed": fixed, "is_article": False}
    best = max(chain, key=lambda t: (t["depth"], t["size"], t["token"]))
    return {"container": [best["token"]], "fixed": fixed, "is_article": False}


def _choose(batches):
    for batch in batches:
        found = [choose(t) for t in batch.column("tokens").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), pa.array([f["container"] for f in found], pa.list_(pa.int64())),
             pa.array([f["fixed"] for f in found], pa.list_(pa.int64())), pa.array([f["is_article"] for f in found])],
            names=["host", "container", "fixed", "is_article"])


def templates(pages: DataFrame) -> DataFrame:
    """host, container, fixed and is_article of every host with at least ``MIN_PAGES`` pages that share a template.

    ``pages`` has url and html.  The tokens listed per host are those that a
    fifth of its pages share, so their number follows the size of a page and
    not the number of pages.
    """
    keyed = pages.select(host_of(F.col("url")).alias("host"), "html").withColumn("print", F.xxhash64("host", "html"))
    tokens = stage(keyed.mapInArrow(_tokenise, _TOKENS), "page_tokens")
    sums = tokens.select("host", "print", "tokens", "kinds").mapInArrow(_vectors, _VECTORS).groupBy("host", "token").agg(
        F.min("kind").alias("kind"), F.sum("v1").alias("v1"), F.sum("v2").alias("v2"), F.sum("pages").alias("pages"))
    shared = stage(sums.filter(F.col("pages") >= MIN_PAGES), "shared_tokens")
    hosts = shared.filter(F.col("token") == _EVERY_PAGE).select("host", F.col("pages").alias("of_host"))
    frequent = stage(shared.filter(F.col("token") != _EVERY_PAGE).join(hosts, "host").filter(F.col("pages") >= MIN_SHARE * F.col("of_host")).select(
        "host", "token", F.xxhash64("v1", "v2", "pages").alias("class")), "frequent_tokens")
    listed = frequent.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("token", "class"))).alias("template"))
    facts = tokens.join(listed, "host").select("host", "tokens", "kinds", "sizes", "template").mapInArrow(_facts, _FACTS).groupBy("host", "token").agg(
        F.min("kind").alias("kind"), F.min("shape").alias("low"), F.max("shape").alias("high"), F.sum("size").alias("size"),
        F.max("main").alias("main"), F.min("depth").alias("depth"), F.max("times").alias("times"))
    valid = facts.filter("low = high and low <> 0").join(frequent, ["host", "token"])
    per_host = valid.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("token", "kind", "class", "size", "main", "depth", "times"))).alias("tokens"))
    return per_host.mapInArrow(_choose, f"host string, {_TEMPLATE}")


def main_text(page: Page, container: list[int] | None, fixed: frozenset[int], is_article: bool) -> str:
    """Text of the container's slots; a page without that element is read by its own elements alone."""
    chosen = {i for i in range(len(page.path)) if container and page.path[i] in container and not page.dropped[i]}
    kept = [j for j in range(len(page.text)) if not page.dropped[page.owner[j]]]
    if chosen and (is_article or not page.main):
        inside = page.within(chosen)
        kept = [j for j in kept if inside[page.owner[j]]]
        if not is_article:
            slots = [j for j in kept if page.tokens[page.run[j]] not in fixed and 2 * page.linked[j] <= len(page.text[j])]
            kept = slots or kept
    elif page.main:
        size = {i: 0 for i in page.main}
        for i in page.main:
            inside = page.within({i})
            size[i] = sum(len(page.text[j]) for j in kept if inside[page.owner[j]])
        best = max(page.main, key=lambda i: (size[i], -i))
        inside = page.within({best})
        kept = [j for j in kept if inside[page.owner[j]]]
    else:
        kept = [j for j in kept if 2 * page.linked[j] <= len(page.text[j])]
        kept = [j for j in kept if page.tokens[page.run[j]] not in fixed] or kept  # pages that are all alike have no slots
    return "\n".join(page.text[j] for j in kept)


def _extract(batches):
    for batch in batches:
        known: dict[str, tuple] = {}
        texts = []
        facts = zip(*(batch.column(c) for c in ("host", "container", "fixed", "is_article")))
        for page, (host, container, fixed, is_article) in zip(_parsed(batch), facts):
            host = host.as_py()
            if host not in known:
                known[host] = (container.as_py(), frozenset(fixed.as_py() or ()), bool(is_article.as_py()))
            texts.append(main_text(page, *known[host]))
        keep = [n for n in batch.schema.names if n not in ("html", "host", "container", "fixed", "is_article")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=[*keep, "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (blocks in page order, one per line) and n_chars of every row of ``pages`` (page_id, url, html).

    A null or empty html, and a page without main text, give an empty text.
    Repeated rows come out as often as they go in; other columns are not
    returned.  Pages without url share the host ''.  Hosts with fewer than
    ``MIN_PAGES`` pages have no template: their pages are read by the article
    or main element with most text, else by all that is neither flagged nor
    mostly links.  Character references are decoded, white space within a
    block becomes one space (br too), inline elements do not end a block.
    """
    found = stage(templates(pages), "page_templates")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    # templates are small: the planner broadcasts them by their measured size, or splits the join's hot hosts
    return rows.join(found, "host", "left").mapInArrow(
        _extract, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")
