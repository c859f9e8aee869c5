"""Main text of web pages: markup as a prior, the suffix array of the host as the judge.

A page is read as blocks. What stands in menus, footers, sidebars, forms and the like is not the text; ``article`` and
``main`` hold the text, and where a page has neither, all other blocks may be it. Every block, whatever its markup, goes
into the suffix array of its host: substrings of at least ``WINDOW`` tokens that stand on most of the host's different texts
are boilerplate. In blocks that markup leaves open the covered tokens are removed and the other runs are kept; a block
inside ``article`` goes where one repeat spans the whole of it and the host has ``LEAST_TEXTS`` different texts. Texts are different if what markup takes for them is: pages
that carry one article under changing menus and adverts count once, however many they are.

The array is built by prefix doubling: suffixes are ranked by their first token, then by pairs of ranks, so by 2, 4, 8, ...
tokens. A suffix whose first tokens too few texts hold is no repeat and leaves. The length of a suffix's longest repeat lies
between the last level it is in and the next; two overlapping names of the level name any such length, and halving finds it.

Before that, suffixes that can't be repeats are left out, which loses none: per host and bucket of window names the pages
are counted, and a window of ``WINDOW`` tokens that enough texts hold is in a bucket that at least as many pages have. The
counters are as many for a host with a third of all pages as for any other.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from evidmill.llm.common import BROADCAST_ROWS, mix, prepare, word_hashes, written
from evidmill.operators.grouping import global_index

WINDOW = 6

# A substring is boilerplate if this many different texts of the host have it, and this share of all its different texts.
LEAST_PAGES = 3
LEAST_SHARE = 0.5

# A host with fewer different texts doesn't outweigh markup: a passage that texts everywhere share is on half of a few by chance.
LEAST_TEXTS = 12

# Buckets a host's window names are counted in, in slices that are added up apart. Hosts with more windows a page than
# buckets only have more suffixes put in order.
BUCKET_BITS = 16
SLICE_BITS = 12

# Characters whose tokens are hashed in one go, and counts a task holds before it writes them.
CHUNK_CHARS = 1 << 20
TALLY_ROWS = 1 << 21

# Page rows whose runs may be broadcast, and hosts whose buckets (8 KB each) may be.
BROADCAST_PAGES = BROADCAST_ROWS // 10
BROADCAST_HOSTS = 4096

# Elements of HTML that are never part of the text, elements whose content is no markup, elements that begin
# a block, and parts of class names, ids and roles by which pages name what surrounds the text.
CHROME_ELEMENTS = frozenset("nav footer aside form header menu button select option input textarea label fieldset dialog template noscript iframe object embed svg math canvas audio video map head title script style datalist".split())
RAW_ELEMENTS = frozenset("script style title textarea iframe noscript template xmp noembed noframes".split())
VOID_ELEMENTS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_ELEMENTS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead title tr ul".split())
CHROME_HINTS = frozenset("nav navbar navigation menu sidebar footer header masthead topbar breadcrumb breadcrumbs pagination pager comment comments respond disqus reply replies ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget toolbar skip copyright search contentinfo complementary".split())
# An element of these closes an open one of those.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIER = frozenset("ul ol dl table div section article main body nav aside footer header form blockquote td th".split())

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")

TEXT, CHROME, OPEN = 0, 1, 2


@dataclass
class Block:
    kind: int
    text: str


def _hinted(attributes: str, inside_text: bool) -> bool:
    """Whether class, id or role name a surrounding part, or the element is hidden. ``header`` says nothing inside a text."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            return True
        if name in ("class", "id", "role"):
            for token in value.split():
                parts = [p.lower() for p in _PART.findall(token)]
                if not parts or parts[0] in ("has", "with", "no", "is", "not"):
                    continue
                found = CHROME_HINTS.intersection(parts)
                if found - {"header"} or (found and not inside_text):
                    return True
    return False


def blocks(page: str | None) -> list[Block]:
    """The non-empty blocks of a page in order. Character references are decoded and white space runs become one blank."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # open elements, each with the kind of its content
    held: list[str] = []
    page = page or ""

    def kind() -> int:
        return stack[-1][1] if stack else OPEN

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(Block(kind(), text))

    def close(at: int) -> None:
        if any(name in BLOCK_ELEMENTS for name, _ in stack[at:]):
            flush()
        del stack[at:]

    position = 0
    while True:
        m = _TAG.search(page, position)
        piece = page[position : m.start() if m else len(page)]
        if piece:
            held.append(html.unescape(piece) if "&" in piece else piece)
        if not m:
            break
        position = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
            if at >= 0:
                close(at)
            elif name in BLOCK_ELEMENTS:
                flush()
            continue
        attributes = m[3] or m[6] or ""
        if name in VOID_ELEMENTS:
            if name == "hr":
                flush()
            elif name == "br":
                held.append(" ")
            continue
        if name in RAW_ELEMENTS:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, position)
            position = end.end() if end else len(page)
            if name in BLOCK_ELEMENTS:
                flush()
            continue
        if name in ("td", "th"):
            held.append(" ")
        closes = {"p"} if name in BLOCK_ELEMENTS else set()
        closes |= _CLOSES.get(name, set())
        if closes:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    close(k)
                    break
                if stack[k][0] in _BARRIER and stack[k][0] not in closes:
                    break
        if name in BLOCK_ELEMENTS:
            flush()
        if attributes.endswith("/") and name not in BLOCK_ELEMENTS:
            continue
        now = kind()
        if now == CHROME:
            # A wrapper that is hinted at but holds the text (a body "with sidebar") doesn't hide it.
            within = CHROME if not (name in ("article", "main") and stack and stack[-1][0] in ("div", "section", "span")) or _hinted(attributes, True) or _said(stack) else TEXT
        elif name in CHROME_ELEMENTS and not (name == "header" and now == TEXT):
            within = CHROME
        elif name in ("article", "main"):
            within = CHROME if name == "article" and _hinted(attributes, True) else TEXT
        elif name not in ("html", "body") and _hinted(attributes, now == TEXT):
            within = CHROME
        else:
            within = now
        stack.append((name, within))
    flush()
    return out


def _said(stack: list[tuple[str, int]]) -> bool:
    """Whether an open element that is chrome by its name, or text already left behind, encloses this place."""
    return any(name in CHROME_ELEMENTS or name in ("article", "main") for name, kind in stack)


@dataclass
class Windows:
    """The tokens of blocks, and the names of the windows that begin at them.

    A block of at least ``WINDOW`` words has a window at every word from which so many follow; a shorter one is one token, which
    no part of a longer block can be. ``names`` are the windows' 64-bit hashes, with the block (``owner``) and the word (``place``)
    each begins at; those from ``n_long`` on are the short blocks. Block ``k`` begins at ``words[first[k]]``.
    """

    words: np.ndarray
    first: np.ndarray
    names: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    n_long: int


def windows(texts: list[str]) -> Windows:
    """The words of all blocks are hashed in one go."""
    sizes = np.array([t.count(" ") + 1 for t in texts], dtype=np.int64)
    words = word_hashes("\n".join(texts).encode(errors="surrogatepass"))
    block = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    n = max(len(words) - WINDOW + 1, 0)
    names = words[:n]
    with np.errstate(over="ignore"):
        for j in range(1, WINDOW):
            names = mix(names * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : j + n])
    start = np.flatnonzero(block[:n] == block[len(words) - n :])
    owner = block[start]
    short = np.flatnonzero(sizes < WINDOW)
    wholes = np.array([_digest(texts[k]) for k in short], dtype=np.int64).view(np.uint64)
    return Windows(words, first, np.concatenate((names[start], wholes)), np.concatenate((owner, short)),
                   np.concatenate((start - first[owner], np.zeros(len(short), np.int64))), len(start))


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


def main_text(found: list[Block], runs: list[tuple[int, int, int]] = (), inside: bool = True) -> str:
    """The text of a page; ``runs``: (block, first word, words) of its repeats that are boilerplate on its host.

    A repeated block of less than ``WINDOW`` words ("Yes.") has a run of one and goes only where it adjoins a removed run or
    the page's edge. Inside ``article`` or ``main`` a block goes only if one run spans it, an edge doesn't count, and a text
    that would lose more words than it keeps is a version of other texts and stays whole; without ``inside`` nothing goes there.
    """
    marked = any(b.kind == TEXT for b in found)
    chosen = [k for k, b in enumerate(found) if b.kind == (TEXT if marked else OPEN)]
    whole = "\n".join(found[k].text for k in chosen)
    spans: dict[int, list[tuple[int, int]]] = {}
    for k, start, length in runs:
        spans.setdefault(k, []).append((start, length))
    if (marked and not inside) or spans.keys().isdisjoint(chosen):
        return whole
    kept = [found[k].text.split(" ") for k in chosen]
    n_words = sum(map(len, kept))
    short = set()
    for at, k in enumerate(chosen):
        n = len(kept[at])
        if n < WINDOW and k in spans:
            short.add(at)
            continue
        for start, length in spans.get(k, ()):
            if not marked or length >= n:
                kept[at][start : start + length] = [""] * length
    for order, near in ((range(len(kept)), -1), (range(len(kept) - 1, -1, -1), 0)):
        adjoins = not marked
        for at in order:
            if at in short and adjoins:
                kept[at] = [""]
            adjoins = not kept[at][near]
    rest = [" ".join(filter(None, words)) for words in kept]
    if marked and 2 * sum(len(t.split(" ")) for t in rest if t) < n_words:
        return whole
    return "\n".join(filter(None, rest))


def n_windows(found: list[Block], runs: list[tuple[int, int, int]]) -> int:
    """How many different windows of a page its repeats hold; short blocks count as one."""
    seen = set()
    for k, start, length in runs:
        words = found[k].text.split(" ")
        if len(words) < WINDOW:
            seen.add(tuple(words))
        else:
            seen.update(tuple(words[j : j + WINDOW]) for j in range(start, start + length - WINDOW + 1))
    return len(seen)


def host_of(url: str):
    """The lower-case host of a URL column; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@\\]*@)?([^/?#:\\]*)", 1), F.lit("")))


def _read(batch: pd.DataFrame) -> Iterator[tuple[list[int], list[list[Block]]]]:
    """The rows of a batch and their blocks, in chunks of bounded size; a longer page is a chunk."""
    rows, found, size = [], [], 0
    for row, page in enumerate(batch["html"]):
        if rows and size + len(page or "") > CHUNK_CHARS:
            yield rows, found
            rows, found, size = [], [], 0
        rows.append(row)
        found.append(blocks(page))
        size += len(page or "")
    if rows:
        yield rows, found


def _rows(pages: DataFrame) -> DataFrame:
    """Pages with an id. ``key`` tells apart rows that repeat an id."""
    return pages.where("page_id IS NOT NULL").select(F.col("page_id").cast("long").alias("page_id"), F.xxhash64("url", "html").alias("key"), host_of("url").alias("host"), "html")


def tallies(pages: DataFrame) -> DataFrame:
    """``host, slice, counts, digest``: pages per bucket of window names, added up in each task, and the digests of the texts.

    ``counts`` has the places of a slice's buckets (16 bits) and how many pages have each (32 bits). Pages with one text in
    one chunk count once. Rows of digests have the slice -1. Pages that markup leaves without text hold nothing.
    """

    def written_out(hosts: dict[str, int], held: list[np.ndarray]):
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        names = list(hosts)
        part = keys >> SLICE_BITS
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        out = []
        for a, b in zip(first, np.append(first[1:], len(keys))):
            blob = (keys[a:b] & ((1 << SLICE_BITS) - 1)).astype(np.uint16).tobytes() + counts[a:b].astype(np.uint32).tobytes()
            out.append((names[int(keys[a]) >> BUCKET_BITS], int(part[a]) & ((1 << BUCKET_BITS - SLICE_BITS) - 1), zlib.compress(blob, 1), None))
        return pd.DataFrame(out, columns=["host", "slice", "counts", "digest"])

    def build(batches):
        hosts, held, size = {}, [], 0
        for batch in batches:
            of = batch["host"].to_numpy()
            texts = []
            for rows, found in _read(batch):
                holders, holder_host, loose, holder = {}, [], [], []
                for row, page in zip(rows, found):
                    text = main_text(page)
                    if not text:
                        continue
                    mine = holders.setdefault((of[row], _digest(text)), len(holders))
                    if mine == len(holder_host):
                        holder_host.append(hosts.setdefault(of[row], len(hosts)))
                    loose += [b.text for b in page]
                    holder += [mine] * len(page)
                if not loose:
                    continue
                texts += [(host, -1, None, digest) for host, digest in holders]
                seen = windows(loose)
                bucket = (seen.names >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
                each = np.unique(np.array(holder)[seen.owner] << BUCKET_BITS | bucket)
                held.append(np.array(holder_host)[each >> BUCKET_BITS] << BUCKET_BITS | each & ((1 << BUCKET_BITS) - 1))
                size += len(each)
                if size > TALLY_ROWS:
                    yield written_out(hosts, held)
                    hosts, held, size = {}, [], 0
            if texts:
                out = pd.DataFrame(texts, columns=["host", "slice", "counts", "digest"])
                out["digest"] = out["digest"].astype("int64")
                yield out
        if held:
            yield written_out(hosts, held)

    return _rows(pages).select("host", "html").mapInPandas(build, "host string, slice int, counts binary, digest long")


def crowded(tally: DataFrame, hosts: DataFrame) -> DataFrame:
    """``host, bits``: one bit for each bucket, set if as many pages have it as a repeat needs texts (``_least`` of ``hosts``)."""
    width = 1 << SLICE_BITS

    def add_up(batches):
        at, least, total = None, 0, None
        for batch in batches:
            out = []
            for host, part, counts, enough in zip(batch["host"], batch["slice"], batch["counts"], batch["_least"]):
                if (host, part) != at:
                    if at is not None and (total >= least).any():
                        out.append((*at, np.packbits(total >= least).tobytes()))
                    at, least, total = (host, part), enough, np.zeros(width, np.int64)
                blob = zlib.decompress(counts)
                n = len(blob) // 6
                total[np.frombuffer(blob, np.uint16, n)] += np.frombuffer(blob, np.uint32, n, 2 * n)
            if out:
                yield pd.DataFrame(out, columns=["host", "slice", "bits"])
        if at is not None and (total >= least).any():
            yield pd.DataFrame([(*at, np.packbits(total >= least).tobytes())], columns=["host", "slice", "bits"])

    counts = tally.where("slice >= 0").join(_small(hosts, BROADCAST_PAGES), "host").select("host", "slice", "counts", "_least")
    slices = counts.repartition("host", "slice").sortWithinPartitions("host", "slice").mapInPandas(add_up, "host string, slice int, bits binary")
    by_slice = slices.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("slice", "bits"))).alias("_m"))
    empty = F.lit(bytes(width // 8))
    return by_slice.select("host", F.concat(*[F.coalesce(F.element_at("_m", F.lit(k)), empty) for k in range(1 << BUCKET_BITS - SLICE_BITS)]).alias("bits"))


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def suffixes(pages: DataFrame, buckets: DataFrame) -> DataFrame:
    """``host, page_id, key, digest, block, place, words``: the stretches of the pages' blocks whose windows can be repeats.

    ``words`` are the tokens from word ``place`` of a block on, as far as one window in a crowded bucket follows another. Every
    token of a stretch begins a suffix. ``digest`` tells apart what markup takes for the texts; it is null for a page without one.
    """

    def build(batches):
        for batch in batches:
            index = {}
            for host, bits in zip(batch["host"], batch["bits"]):
                if host not in index:
                    index[host] = (len(index), bits)
            bits = np.frombuffer(b"".join(b for _, b in index.values()), np.uint8).reshape(len(index), -1)
            of = np.array([index[h][0] for h in batch["host"]], dtype=np.int64)
            for rows, found in _read(batch):
                loose = [b.text for page in found for b in page]
                if not loose:
                    continue
                sizes = [len(page) for page in found]
                page = np.repeat(np.arange(len(found)), sizes)
                inside = np.arange(len(loose)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                seen = windows(loose)
                bucket = (seen.names >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
                hit = np.flatnonzero(bits[of[np.array(rows)[page[seen.owner]]], bucket >> 3] >> (7 - (bucket & 7)) & 1)
                if not len(hit):
                    continue
                owner, place, long = seen.owner[hit], seen.place[hit], hit < seen.n_long
                begins = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1))))
                out, digests = [], {}
                for a, b in zip(begins, np.append(begins[1:], len(hit))):
                    k = owner[a]
                    at = seen.first[k] + place[a]
                    words = seen.words[at : at + b - a + WINDOW - 1] if long[a] else seen.names[hit[a] : hit[a] + 1]
                    p = int(page[k])
                    if p not in digests:
                        text = main_text(found[p])
                        digests[p] = _digest(text) if text else None
                    row = rows[p]
                    out.append((batch["host"][row], batch["page_id"][row], batch["key"][row], digests[p], int(inside[k]), int(place[a]), words.view(np.int64)))
                made = pd.DataFrame(out, columns=["host", "page_id", "key", "digest", "block", "place", "words"])
                made["digest"] = made["digest"].astype("Int64")
                yield made

    rows = _rows(pages).join(_small(buckets, BROADCAST_HOSTS), "host").select("page_id", "key", "host", "html", "bits")
    return rows.mapInPandas(build, "host string, page_id long, key long, digest long, block int, place int, words array<long>")


def _held(rows: DataFrame, holders: DataFrame, by: list[str]) -> DataFrame:
    """The values of ``by`` that enough texts hold. ``rows`` has ``sid`` and ``by``."""
    held = rows.select("sid", *by).distinct().join(holders, "sid").groupBy(*by).agg(F.count_distinct("digest").alias("_held"), F.max("_least").alias("_least"))
    return held.where("_held >= _least").select(*by)


def repeats(stretches: DataFrame, holders: DataFrame) -> DataFrame | None:
    """``sid, pos, length``: for suffixes of ``stretches`` (``sid, host, words``) the longest beginning that enough texts hold.

    ``holders`` has the texts of each stretch as ``sid, digest, _least``. The result is none where no token is held by enough.
    """

    def rank(rows: DataFrame, by: list[str]) -> DataFrame:
        named = global_index(_held(rows, holders, by), [F.col(c) for c in by], "name")
        return written(rows.join(named, by).select("sid", "pos", "name"), "rank")

    levels = []
    level = rank(stretches.select("sid", "host", F.posexplode("words").alias("pos", "word")), ["host", "word"])
    while not level.isEmpty():
        follows = level.select("sid", (F.col("pos") - (1 << len(levels))).alias("pos"), F.col("name").alias("_r"))
        levels.append(level.withColumn("level", F.lit(len(levels))))
        level = rank(written(level.withColumnRenamed("name", "_l").join(follows, ["sid", "pos"]), "pairs"), ["_l", "_r"])
    if not levels:
        return None
    names = levels[0]
    for level in levels[1:]:
        names = names.union(level)
    # Two names of a level, overlapping, name every length up to the next level, so the length is found by halving.
    size = F.expr("shiftleft(1, level)")
    ends = names.select("level", "sid", F.col("pos").alias("_at"), F.col("name").alias("_r"))
    top = names.groupBy("sid", "pos").agg(F.max_by("name", "level").alias("name"), F.max("level").alias("level"))
    found = written(top.withColumn("length", size), "lengths")
    for step in reversed(range(len(levels) - 1)):
        tried = found.where(F.col("level") > step).select("level", "name", (F.col("length") + (1 << step)).alias("_try")).distinct()
        # Whoever has the beginning is counted, whatever length it has reached itself.
        members = tried.join(names, ["level", "name"]).withColumn("_at", F.col("pos") + F.col("_try") - size).join(ends, ["level", "sid", "_at"])
        members = written(members.select("sid", "pos", "level", "name", "_try", "_r"), "members")
        longer = members.join(_held(members, holders, ["level", "name", "_try", "_r"]), ["level", "name", "_try", "_r"]).select("sid", "pos", "level", (F.col("_try") - (1 << step)).alias("length"), F.lit(1 << step).alias("_more"))
        found = written(found.join(longer, ["sid", "pos", "level", "length"], "left").select(
            "sid", "pos", "name", "level", (F.col("length") + F.coalesce("_more", F.lit(0))).alias("length")), "lengths")
    return found.select("sid", "pos", "length")


def boilerplate(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame | None:
    """``page_id, key, runs, inside``: per page row its repeats that most different texts of its host have; none if there are none.

    ``runs`` has block, first word and words of each repeat, one after the other. A repeat inside a longer one isn't listed.
    ``inside``: whether the host has texts enough to judge what markup takes for the text.
    """
    tally = written(tallies(pages), "tallies")
    texts = tally.where("slice < 0").select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("_texts"))
    least = F.greatest(F.lit(least_pages), F.ceil(F.col("_texts") * least_share)).cast("long")
    hosts = written(texts.where(F.col("_texts") >= least_pages).select("host", least.alias("_least"), (F.col("_texts") >= LEAST_TEXTS).alias("inside")), "hosts")
    if hosts.isEmpty():
        return None
    found = written(suffixes(pages, written(crowded(tally, hosts), "crowded")), "suffixes")
    # A stretch is put in order once, however many pages have it.
    stretches = written(found.select("host", "words").distinct().withColumn("sid", F.monotonically_increasing_id()), "stretches")
    placed = written(found.join(stretches, ["host", "words"]).select("host", "page_id", "key", "digest", "block", "place", "sid"), "placed")
    holders = written(placed.where("digest IS NOT NULL").select("host", "sid", "digest").distinct().join(_small(hosts, BROADCAST_PAGES), "host").select("sid", "digest", "_least"), "holders")
    lengths = repeats(stretches, holders)
    if lengths is None:
        return None
    short = stretches.where(F.size("words") == 1).select("sid", F.lit(True).alias("_short"))
    enough = lengths.join(short, "sid", "left").where(F.col("_short") | (F.col("length") >= WINDOW))
    before = F.lag("length").over(Window.partitionBy("sid").orderBy("pos")) + F.lag("pos").over(Window.partitionBy("sid").orderBy("pos"))
    outer = enough.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") < F.col("pos") + F.col("length")))
    runs = outer.join(placed, "sid").join(_small(hosts.select("host", "inside"), BROADCAST_PAGES), "host")
    runs = runs.select("page_id", "key", F.array("block", F.col("place") + F.col("pos"), F.col("length")).alias("_run"), "inside")
    return runs.groupBy("page_id", "key").agg(F.flatten(F.collect_set("_run")).alias("runs"), F.max("inside").alias("inside"))


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars, n_repeated``: one row per row of ``pages``.

    Null html is an empty page; pages without text have the empty text. Pages without id are read by their markup alone,
    rows that repeat an id are read like any other. ``n_repeated`` counts the page's windows that are boilerplate on its host. Other
    columns are ignored; an empty table gives no rows.
    """
    prepare(pages.sparkSession)

    @F.pandas_udf("text string, n_chars long, n_repeated long")
    def read(html_text: pd.Series, runs: pd.Series, inside: pd.Series) -> pd.DataFrame:
        texts, counts = [], []
        for page, flat, judged in zip(html_text, runs, inside):
            found = blocks(page)
            mine = [] if flat is None else [tuple(run) for run in np.asarray(flat).reshape(-1, 3).tolist()]
            texts.append(main_text(found, mine, bool(judged)))
            counts.append(n_windows(found, mine))
        return pd.DataFrame({"text": pd.Series(texts, dtype=object), "n_chars": [len(t) for t in texts], "n_repeated": counts})

    found = boilerplate(pages, least_pages)
    rows = pages.select("page_id", "url", "html")
    if found is None:
        rows = rows.withColumns({"runs": F.lit(None).cast("array<int>"), "inside": F.lit(False)})
    else:
        found = written(found, "runs").withColumnsRenamed({"page_id": "_page", "key": "_key"})
        same = (F.col("page_id").cast("long") == F.col("_page")) & (F.xxhash64("url", "html") == F.col("_key"))
        rows = rows.join(_small(found, BROADCAST_PAGES), same, "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    return rows.select("page_id", "url", read("html", "runs", "inside").alias("_t")).select("page_id", "url", "_t.*")
