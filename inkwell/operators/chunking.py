"""Chunkers, grouping of blocks, context and page attribution.

Windows and sections are expressions; what depends on all that came before (packing, recursion, similarity runs)
is a generator over Arrow batches, one document at a time.
"""

from __future__ import annotations

import html.parser
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .documents import TEXT_TYPES, joined

# Separators of the recursive chunker, from coarse to fine.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "，", " ", "")
# The chunker of each profile and its parameters.
PROFILES = {
    "technical": ("markdown", {"least": 40, "most": 1600}),
    "long_form": ("semantic", {"threshold": 0.55, "least": 120, "most": 1800}),
    "layout": ("preserve", {}),
    "short_qa": ("fixed", {"size": 500, "overlap": 60, "least": 20}),
    "high_value": ("semantic", {"threshold": 0.55, "least": 100, "most": 1600}),
    "spreadsheet": ("preserve", {}),
}
SENTENCE_ENDS = (r"[。！？.!?；\n]+", ("。", "！", "？", ";", ".", "!", "?"))


def hard_windows(docs: DataFrame, size: int = 500, overlap: int = 80, least: int = 50, key="doc_id") -> DataFrame:
    """key, pos, chunk: windows of `size` characters that overlap, the last one the first that reaches the end; a text that fits is one."""
    n, step = F.length("text"), size - overlap
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (F.ceil((n - size) / step) * step).cast("int"), F.lit(step)))
    w = docs.filter("text is not null").select(key, "text", F.posexplode(starts).alias("pos", "s"))
    return w.select(key, "pos", F.substring("text", F.col("s") + 1, F.lit(size)).alias("chunk")).filter(F.length("chunk") >= least)


def sliding(docs: DataFrame, size: int = 5, step: int = 2, least: int = 50, key="doc_id") -> DataFrame:
    """key, pos, chunk: windows of sentences, the last one the first that reaches the end; few sentences: the whole text."""
    ends, marks = SENTENCE_ENDS
    found = F.filter(F.array(*map(F.lit, marks)), lambda m: F.instr("text", m) > 0)
    # a generator of one row: parts and marks are computed once a document, not anew in every lambda below
    once = F.inline(F.array(F.struct(T.sentence_parts(F.col("text"), ends).alias("parts"), found.alias("found"))))
    s = docs.filter("text is not null").select(key, "text", once)
    s = s.select(key, "text", F.inline(F.array(F.struct(T.marked_sentences(F.col("parts"), F.col("found")).alias("s")))))
    n = F.size("s")
    last = F.ceil((n - size) / step).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice("s", k * step + 1, F.lit(size)), "\n"))
    chunks = F.when(n > size, windows).when(n > 0, F.array(F.col("text")))
    return s.select(key, F.posexplode(chunks).alias("pos", "chunk")).filter(F.length("chunk") >= least)


def sections(lines: DataFrame, key="doc_id", heading=r"^#{1,6}[ \t]") -> DataFrame:
    """Lines(key, pos, line) as sections: each starts at a heading line; 0 is what stands before the first."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("line").rlike(heading)
    s = lines.withColumn("section", F.sum(head.cast("long")).over(w)).withColumn("_h", F.when(head, F.col("line")))
    return s.groupBy(key, "section").agg(F.first("_h", ignorenulls=True).alias("title"), F.count(F.lit(1)).alias("n_lines"), joined("pos", "line", "\n").alias("text"))


# --- sequential chunkers: plain generators, run over Arrow batches ---


def packed(text: str, size: int, overlap: int, windows):
    """Lines packed up to size, the tail of a chunk opening the next; a line over it alone, as windows(line)."""
    out, now = [], ""
    for line in filter(None, map(str.strip, text.splitlines())):
        if len(line) > size:
            out += [now] if now else []
            now = ""
            out += windows(line)
        elif now and len(now) + 1 + len(line) > size:
            out.append(now)
            now = f"{now[-overlap:] if overlap else ''}\n{line}".strip()
        else:
            now = f"{now}\n{line}" if now else line
    return [*out, now] if now else out


def fixed(text: str, size: int = 500, overlap: int = 80, least: int = 50):
    """Packed lines; a line over the size in overlapping windows, the last one the first that reaches its end."""
    step = size - overlap
    chunks = packed(text, size, overlap, lambda line: [line[i : i + size].strip() for i in range(0, len(line) - overlap, step)])
    return [c for c in map(str.strip, chunks) if len(c) >= least]


def recursive(text: str, size: int = 500, least: int = 50, separators=SEPARATORS):
    """Pieces at each separator in turn, from coarse to fine, packed up to size; pieces over it go on to the next. On every
    level what is shorter than `least` joins the piece before, whatever its size."""

    def level(t: str, k: int) -> list[str]:
        if k == len(separators) or not separators[k]:
            return [t[i : i + size] for i in range(0, len(t), size)]
        pieces, now = [], ""
        for part in t.split(separators[k]):
            if now and len(now) + len(separators[k]) + len(part) <= size:
                now += separators[k] + part
                continue
            if now:
                pieces.append(now)
            now = part if len(part) <= size else ""
            if len(part) > size:
                pieces += level(part, k + 1)
        joined_: list[str] = []
        for piece in [*pieces, now] if now else pieces:
            if joined_ and len(piece) < least:
                joined_[-1] += piece
            else:
                joined_.append(piece)
        return joined_

    return [c for c in level(text, 0) if len(c) >= least] if text.strip() else []


def sentences(text: str, ends: str = r"[。！？.!?\n]+", marks: str = "。！？.!?"):
    parts = [p.strip() for p in re.split(ends, text)]
    return [p + next((m for m in marks if p + m in text), "") for p in parts if p]


def hash_vector(text: str, width: int = 64) -> list[float]:
    """A deterministic stand-in for an embedding model: signed hashed character trigrams, of length 1."""
    import zlib

    v = [0.0] * width
    for i in range(max(1, len(text) - 2)):
        h = zlib.crc32(text[i : i + 3].encode())
        v[h % width] += 1.0 if h >> 16 & 1 else -1.0
    norm = sum(x * x for x in v) ** 0.5
    return [x / norm for x in v] if norm else v


def semantic(text: str, threshold: float = 0.5, least: int = 100, most: int = 1500, embed=hash_vector):
    """Sentences joined while they resemble the one before or the chunk is short, split where it would be too long."""
    s = sentences(text)
    if len(s) <= 1:
        return [text] if s else []
    v, out, now = [embed(x) for x in s], [], s[0]
    for i in range(1, len(s)):
        alike = sum(a * b for a, b in zip(v[i - 1], v[i]))
        if len(now) + len(s[i]) > most or (alike < threshold and len(now) >= least):
            out.append(now)
            now = s[i]
        else:
            now += s[i]
    return [c for c in [*out, now] if len(c) >= least]


def token_estimate(text: str, most: int = 500, overlap: int = 50, least: int = 50):
    """Packed lines by estimated tokens of three characters each; a line over the size in windows from end to end."""
    size, shared = most * 3, overlap * 3
    chunks = packed(text, size, shared, lambda line: [line[i : i + size] for i in range(0, len(line), size - shared)])
    return [c for c in chunks if len(c) >= least]


def markdown(text: str, least: int = 100, most: int = 2000):
    """Sections at headings, each with its heading line; those too long packed by blank lines."""
    found, now = [], ["", []]
    for line in text.split("\n"):
        if re.match(r"#{1,6}\s", line):
            found.append(now)
            now = [line, []]
        else:
            now[1].append(line)
    found.append(now)
    out = []
    for title, body in found:
        body = "\n".join(body).strip()
        whole = f"{title}\n{body}".strip() if title else body
        if len(whole) <= most:
            out.append(whole)
            continue
        pack = ""
        for para in filter(None, (p.strip() for p in body.split("\n\n"))):
            if pack and len(title) + len(pack) + len(para) + 3 > most:
                out.append(f"{title}\n{pack}".strip())
                pack = ""
            pack = f"{pack}\n\n{para}" if pack else para
        out.append(f"{title}\n{pack}".strip())
    return [c for c in out if len(c) >= least]


def preserve(text: str):
    """A block as it is, without white space at its ends."""
    return [text.strip()]


CHUNKERS = {"preserve": preserve, "fixed": fixed, "recursive": recursive, "semantic": semantic, "token": token_estimate, "markdown": markdown}


def check_parameters(name: str, **p) -> None:
    """Raise ValueError for parameters that no text can be chunked with."""
    size = p.get("size") or p.get("most")
    if p.get("overlap") is not None and size is not None and not 0 <= p["overlap"] < size:
        raise ValueError("overlap must be less than the size")
    if p.get("least") is not None and p.get("most") is not None and p["least"] >= p["most"]:
        raise ValueError("the least size must be less than the most")
    if p.get("step") is not None and p.get("size") is not None and not 0 < p["step"] <= p["size"]:
        raise ValueError("the step must be at most the size")
    if name not in CHUNKERS and name != "sliding":
        raise ValueError(f"unknown chunker: {name}")


def chunk(docs: DataFrame, name: str, key="doc_id", **parameters) -> DataFrame:
    """key, pos, chunk by a named sequential chunker. No shuffle."""
    check_parameters(name, **parameters)
    f = CHUNKERS[name]

    def run(batches):
        for b in batches:
            rows = [(k, i, c) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t and t.strip() for i, c in enumerate(f(t, **parameters))]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], [key, "pos", "chunk"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, pos int, chunk string")


def chunk_by_profile(docs: DataFrame, key="doc_id", profile="profile") -> DataFrame:
    """key, profile, pos, chunk: each text by the chunker and parameters of its own profile. A profile that is
    not one of PROFILES is an error, a null one is short_qa; blank and null texts have no chunks. No shuffle."""

    def run(batches):
        for b in batches:
            rows = []
            for k, p, t in zip(*[c.to_pylist() for c in b.columns]):
                if p is not None and p not in PROFILES:
                    raise ValueError(f"unknown profile: {p}")
                if t and t.strip():
                    name, parameters = PROFILES[p or "short_qa"]
                    rows += [(k, p or "short_qa", i, c) for i, c in enumerate(CHUNKERS[name](t, **parameters))]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], [key, "profile", "pos", "chunk"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, profile, "text").mapInArrow(run, f"{key} {kind}, profile string, pos int, chunk string")


def group_long_form(blocks: DataFrame) -> DataFrame:
    """Neighbouring text blocks of one heading path and source as one; others stand alone.

    blocks: document_id, block_pos, content_type, heading, source_type, text. Islands by a change flag and its running sum."""
    w = Window.partitionBy("document_id").orderBy("block_pos")
    is_text = F.col("content_type").isin(*TEXT_TYPES)
    same = is_text & F.lag(is_text).over(w) & F.col("heading").eqNullSafe(F.lag("heading").over(w)) & F.col("source_type").eqNullSafe(F.lag("source_type").over(w))
    g = blocks.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    g = g.withColumn("grp", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("document_id", "grp").agg(F.min("block_pos").alias("first_pos"), F.count(F.lit(1)).alias("n_blocks"), F.min_by("content_type", "block_pos").alias("content_type"), joined("block_pos", "text", "\n\n").alias("text"))


def long_form_groups(blocks: DataFrame) -> DataFrame:
    """document_id, grp, first_pos, n_blocks, content_type, page_number, text and segments of long-form groups.

    blocks: document_id, block_pos, content_type, heading, source_type, slide_number, page_number, text. Neighbouring text blocks
    of one heading, source and slide are one group; a table, formula or picture stands alone and parts what is around it. A
    group of one block is that block as it is. Of several with pages, white space collapses, texts are joined by a space, and
    segments(start, end, page) say which characters (end exclusive) come from which page; without pages texts are
    trimmed and joined by a blank line. segments is null where nothing was joined by pages. One sort a document."""
    w = Window.partitionBy("document_id").orderBy("block_pos")
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    is_text = F.coalesce(F.col("content_type").isin(*TEXT_TYPES), F.lit(False))
    same = is_text & F.coalesce(F.lag(is_text).over(w), F.lit(False))
    for c in ("heading", "source_type", "slide_number"):
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    g = blocks.withColumn("_new", (~same).cast("int")).withColumn("grp", F.sum("_new").over(to_here))
    body = F.coalesce("text", F.lit(""))
    g = g.withColumn("_piece", T.strip(F.regexp_replace(body, r"[ \t\n\r\x0b\x0c]+", " "))).withColumn("_size", F.when(F.col("_piece") != "", F.length("_piece") + 1).otherwise(0))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("document_id", "grp").orderBy("block_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    g = g.withColumn("_start", before)
    full = F.when(F.col("_piece") != "", F.struct("block_pos", F.col("_piece").alias("piece"), T.strip(body).alias("own"), F.struct(F.col("_start").alias("start"), (F.col("_start") + F.col("_size") - 1).alias("end"), F.col("page_number").alias("page")).alias("segment")))
    first = lambda c: F.min_by(c, "block_pos")
    a = g.groupBy("document_id", "grp").agg(F.min("block_pos").alias("first_pos"), F.count(F.lit(1)).alias("n_blocks"), first("content_type").alias("content_type"), first("page_number").alias("page_number"), first("text").alias("_first"), F.bool_or(F.col("page_number").isNotNull()).alias("_paged"), F.array_sort(F.collect_list(full)).alias("_all"))
    one, part = F.col("n_blocks") == 1, lambda c: F.transform("_all", lambda x: x[c])
    text = F.when(one, F.col("_first")).when(F.col("_paged"), F.array_join(part("piece"), " ")).otherwise(F.array_join(part("own"), "\n\n"))
    return a.select("document_id", "grp", "first_pos", "n_blocks", "content_type", "page_number", text.alias("text"), F.when(~one & F.col("_paged"), part("segment")).alias("segments"))


def group_structured(blocks: DataFrame) -> DataFrame:
    """Sections anew as Markdown: a heading opens one, text goes on, anything else ends it and stands alone.

    blocks: document_id, block_pos, content_type, depth, text."""
    w = Window.partitionBy("document_id").orderBy("block_pos")
    is_text, is_head = F.col("content_type").isin(*TEXT_TYPES), F.col("content_type") == "heading"
    new = is_head | ~is_text | ~F.coalesce(F.lag(is_text).over(w), F.lit(False))
    part = F.when(is_head, F.concat(F.repeat(F.lit("#"), F.greatest(F.col("depth"), F.lit(1))), F.lit(" "), T.strip(F.regexp_replace(T.strip(F.col("text")), "^#+", "")))).when(is_text, T.strip(F.col("text"))).otherwise(F.col("text"))
    g = blocks.withColumn("part", part).withColumn("grp", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("trim(part) != ''")
    return g.groupBy("document_id", "grp").agg(F.min("block_pos").alias("first_pos"), F.count(F.lit(1)).alias("n_blocks"), joined("block_pos", "part", "\n\n").alias("text"))


def bind_context(blocks: DataFrame, n: int = 150) -> DataFrame:
    """Beside pictures and formulas, the end of the last text before and the start of the first after."""
    w = Window.partitionBy("document_id").orderBy("block_pos")
    text = F.when(F.col("content_type").isin(*TEXT_TYPES), F.col("text"))
    before = F.last(text, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(text, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    wanted = F.col("content_type").isin("image_description", "formula", "image_ocr")
    return blocks.withColumns({"before": before, "after": after}).withColumn("context", F.when(wanted, F.concat_ws("\n", F.right("before", F.lit(n)), F.substring("after", 1, n))))


def units_of(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """What is chunked: blocks put together as their document's profile wants, one row a unit.

    blocks: document_id, block_pos, content_type, heading, source_type, slide_number, page_number, depth, text; docs: document_id,
    profile, parent_child, reconstructed, one row a document. Sections anew where reconstructed, long-form groups where there
    are parents otherwise, else blocks as they are. A unit has the heading, type and page of its first block, unit_pos in
    its document and, beside pictures and formulas, context. Blocks of documents that docs does not hold are left out."""
    b = blocks.join(docs.select("document_id", "parent_child", "reconstructed"), "document_id")
    how = F.when(F.col("reconstructed"), "sections").when(F.col("parent_child"), "groups").otherwise("apart")
    of = lambda name: b.filter(how == name).drop("parent_child", "reconstructed")
    own = ["document_id", F.col("block_pos").alias("first_pos"), "content_type", "heading", "page_number"]
    none = F.lit(None).cast("array<struct<start:int,end:int,page:int>>").alias("segments")
    first = b.select(*own)
    made = group_structured(of("sections")).select("document_id", "first_pos", "text", none)
    made = made.unionByName(long_form_groups(of("groups").withColumn("page_number", F.col("page_number").cast("int"))).select("document_id", "first_pos", "text", "segments"))
    units = of("apart").select(*own, "text", none).unionByName(made.join(first, ["document_id", "first_pos"]))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("first_pos")) - 1
    units = bind_context(units.withColumn("unit_pos", place).withColumnRenamed("first_pos", "block_pos")).drop("before", "after")
    return units.join(docs.select("document_id", "profile", "parent_child"), "document_id")


def assembled_chunks(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks of documents as they are stored: document_id, chunk_index, parent_chunk_id, content_type, heading, page_number,
    profile, chunk_level, parent_content, context_prefix, search_text, content.

    docs as for units_of, with filename. Each unit is chunked by its profile's chunker; one that this leaves without a chunk
    is a chunk itself, blank units have none. What is searched is the file's name and heading, the context beside a picture
    or formula, and the chunk. Chunks of profiles with parents carry their unit's text. The profile must be one of PROFILES."""
    units = units_of(blocks, docs).filter(T.strip(F.coalesce("text", F.lit(""))) != "").select("document_id", "unit_pos", "content_type", "heading", "page_number", "profile", "parent_child", "context", "text")

    def run(batches):
        for b in batches:
            found = []
            for i, (profile, text) in enumerate(zip(b.column("profile").to_pylist(), b.column("text").to_pylist())):
                name, parameters = PROFILES[profile]
                kept = [c.strip() for c in CHUNKERS[name](text, **parameters) or [text]]
                found += [(i, k, c) for k, c in enumerate(filter(None, kept))]
            at, pos, content = zip(*found) if found else ((), (), ())
            taken = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(pos, pa.int32()), pa.array(content, pa.string())], [*b.schema.names, "inner_pos", "content"])

    c = units.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in units.dtypes) + ", inner_pos int, content string")
    c = c.join(docs.select("document_id", "filename"), "document_id")
    full = lambda *cols: F.array_join(F.filter(F.array(*[F.coalesce(x, F.lit("")) for x in cols]), lambda x: x != ""), "\n")
    prefix = full(T.strip(F.col("filename")), F.col("heading"))
    index = F.row_number().over(Window.partitionBy("document_id").orderBy("unit_pos", "inner_pos")) - 1
    return c.select(
        "document_id",
        index.alias("chunk_index"),
        F.concat(F.col("document_id").cast("string"), F.lit(":parent:"), F.col("unit_pos").cast("string")).alias("parent_chunk_id"),
        "content_type", "heading", "page_number", "profile",
        F.col("parent_child").cast("int").alias("chunk_level"),
        F.when(F.col("parent_child"), T.strip(F.col("text"))).otherwise("").alias("parent_content"),
        prefix.alias("context_prefix"),
        full(prefix, T.strip(F.col("context")), F.col("content")).alias("search_text"),
        "content",
    )


class _Article(html.parser.HTMLParser):
    """Blocks of what stands in main or article, without navigation, scripts and the like."""

    SKIP = {"nav", "aside", "header", "footer", "script", "style", "form", "noscript", "button", "svg"}
    VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.path, self.text = [], [], []
        self.inside = self.skipping = 0
        self.kind, self.cells, self.rows, self.items = None, None, None, None

    def flush(self, kind=None):
        text = "".join(self.text)
        self.text = []
        text = text.strip("\n") if kind == "code" else re.sub(r"\s+", " ", text).strip()
        if text:
            self.blocks.append((kind or "paragraph", text, " > ".join(t for _, t in self.path)))

    def handle_starttag(self, tag, attrs):
        if tag in ("main", "article"):
            self.inside += 1
        if not self.inside or tag in self.VOID:
            if self.inside and tag == "br":
                self.text.append(" ")
            if self.inside and tag == "img" and (alt := dict(attrs).get("alt")):
                self.flush()
                self.text = [f"图片：{alt}"]
                self.flush("image_description")
            return
        if tag in self.SKIP:
            self.skipping += 1
        if self.skipping:
            return
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "pre", "ul", "ol", "table"):
            self.flush()
        if tag in ("ul", "ol"):
            self.items = []
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th", "li"):
            self.text = []

    def handle_endtag(self, tag):
        if not self.inside:
            return
        if tag in self.SKIP and self.skipping:
            self.skipping -= 1
            return
        if self.skipping:
            return
        if re.fullmatch("h[1-6]", tag):
            title = re.sub(r"\s+", " ", "".join(self.text)).strip()
            level = int(tag[1])
            while self.path and self.path[-1][0] >= level:
                self.path.pop()
            if title:
                self.path.append((level, title))
            self.flush("heading")
        elif tag == "p":
            self.flush()
        elif tag == "pre":
            self.flush("code")
        elif tag == "li" and self.items is not None:
            self.items.append(re.sub(r"\s+", " ", "".join(self.text)).strip())
            self.text = []
        elif tag in ("ul", "ol") and self.items is not None:
            self.text, self.items = ["；".join(filter(None, self.items))], None
            self.flush("paragraph")
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append(re.sub(r"\s+", " ", "".join(self.text)).strip())
            self.text = []
        elif tag == "table" and self.rows is not None:
            self.text, self.rows = ["\n".join(" | ".join(r) for r in self.rows if any(r))], None
            if text := "".join(self.text):
                self.blocks.append(("table", text, " > ".join(t for _, t in self.path)))
            self.text = []
        elif tag in ("main", "article"):
            self.flush()
            self.inside -= 1

    def handle_data(self, data):
        if self.inside and not self.skipping:
            self.text.append(data)


def html_blocks(pages: DataFrame, key="page_id", html_col="html") -> DataFrame:
    """key, block_pos, content_type, text, heading of each block of a page's article."""

    def run(batches):
        for b in batches:
            rows = []
            for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = _Article()
                p.feed(h or "")
                p.close()
                p.flush()
                rows += [(k, i, *x) for i, x in enumerate(p.blocks)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.string()) for c in cols[2:]]], [key, "block_pos", "content_type", "text", "heading"])

    return pages.select(key, html_col).mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, block_pos int, content_type string, text string, heading string")


def markdown_blocks(text: str):
    """(content_type, text, heading path) of each block: fenced code, pipe tables with a separator row, headings, paragraphs."""
    out, path, para = [], [], []
    lines = text.split("\n")
    where = lambda: " > ".join(t for _, t in path)

    def flush():
        body = "\n".join(para).strip()
        para.clear()
        if body:
            out.append(("paragraph", body, where()))

    i = 0
    while i < len(lines):
        line = lines[i]
        if line.lstrip().startswith("```"):
            flush()
            j = i + 1
            while j < len(lines) and not lines[j].lstrip().startswith("```"):
                j += 1
            out.append(("code", "\n".join(lines[i + 1 : j]), where()))
            i = j + 1
        elif (m := re.match(r"(#{1,6})\s+(.*\S)", line)) is not None:
            flush()
            while path and path[-1][0] >= len(m[1]):
                path.pop()
            path.append((len(m[1]), m[2]))
            out.append(("heading", m[2], where()))
            i += 1
        elif "|" in line and i + 1 < len(lines) and "-" in lines[i + 1] and re.fullmatch(r"[\s|:\-]+", lines[i + 1]):
            flush()
            j = i
            while j < len(lines) and "|" in lines[j]:
                j += 1
            out.append(("table", "\n".join(lines[i:j]), where()))
            i = j
        else:
            if line.strip():
                para.append(line)
            else:
                flush()
            i += 1
    flush()
    return out


# What begins a fence, a heading and a table's row, and what a separator's cells are, on trimmed lines.
FENCE, HEADING, TABLE_ROW, SEPARATOR_CELL = "```", r"(#{1,6})\s+(.+)", r"\|.+\|", r":?-{3,}:?"


def parsed_markdown(text: str):
    """(content_type, text, heading path) of each block: lines up to the next heading, table or fence are one text, blank
    ones included; a fence without an end runs to the end. A heading drops from the path what stands at its own level or
    below by position, at most as many entries as levels from it to the heading before."""
    out, path, at, held = [], [], 0, []
    lines = text.split("\n")
    bare = [line.strip() for line in lines]
    cells = lambda row: [c.strip() for c in row.strip("|").split("|")]

    def close(kind="text"):
        body = "\n".join(held).strip()
        held.clear()
        if body:
            out.append((kind, body, " > ".join(path)))

    i = 0
    while i < len(lines):
        if bare[i].startswith(FENCE):
            close()
            end = next((j for j in range(i + 1, len(lines)) if bare[j].startswith(FENCE)), len(lines))
            held += lines[i + 1 : end]
            close("code")
            i = end + 1
        elif re.fullmatch(TABLE_ROW, bare[i]) and i + 1 < len(lines) and all(re.fullmatch(SEPARATOR_CELL, c) for c in cells(bare[i + 1])):
            close()
            end = next((j for j in range(i, len(lines)) if not re.fullmatch(TABLE_ROW, bare[j])), len(lines))
            out.append(("table", "\n".join(bare[i:end]), " > ".join(path)))
            i = end
        else:
            if m := re.fullmatch(HEADING, bare[i]):
                close()
                level = len(m[1])
                path = [*path[: len(path) - max(0, min(at, len(path)) - level + 1)], m[2].strip()]
                at = level
                out.append(("heading", path[-1], " > ".join(path)))
            else:
                held.append(lines[i])
            i += 1
    close()
    return out


def md_blocks(docs: DataFrame, key="doc_id", read=parsed_markdown) -> DataFrame:
    """key, block_pos, content_type, text, heading of Markdown texts. `read` may be markdown_blocks, where a blank line ends
    a paragraph and a separator may be shorter. Null texts have no blocks."""
    def run(batches):
        for b in batches:
            rows = [(k, i, *x) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, x in enumerate(read(t or ""))]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.string()) for c in cols[2:]]], [key, "block_pos", "content_type", "text", "heading"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, block_pos int, content_type string, text string, heading string")
