"""Reading repositories of Markdown files, their front matter, and the marked blocks written into them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "SKILL.md"
REFERENCE_DIRS = ("references", "reference", "docs", "guides")  # names of folders whose files belong to the skill above
DISPOSITIONS = ("supported", "unsupported", "unreadable", "excluded")


def glob_regex(pattern: str) -> str:
    """The regular expression of a glob: ``**/`` any folders, ``*`` and ``?`` within a name."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
    return f"^{out}$"


def matches_glob(path: Column, pattern: str) -> Column:
    """The whole path, else the file name by the pattern without leading ``**/``, else the file name."""
    name = F.element_at(F.split(path, "/"), -1)
    return path.rlike(glob_regex(pattern)) | name.rlike(glob_regex(pattern.removeprefix("**/"))) | name.rlike(glob_regex(pattern))


def scan(spark: SparkSession, root: str, patterns: tuple[str, ...] = ("**/*.md",), ignore: tuple[str, ...] = ()) -> DataFrame:
    """path, disposition, skill, text of every file below a folder.

    Files of other patterns, with NUL or not in UTF-8 are unsupported, ignored ones excluded. A file belongs to the
    skill whose marker file stands in the nearest folder above it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file:").lstrip("/")
    rows = files.select(F.regexp_replace("path", rf"^[a-z]+:/*{re.escape(base)}/", "").alias("path"), "content")
    return dispose(rows, patterns, ignore)


def dispose(rows: DataFrame, patterns: tuple[str, ...] = ("**/*.md",), ignore: tuple[str, ...] = ()) -> DataFrame:
    """The same for rows of path and content."""
    listed, dropped = F.lit(False), F.lit(False)
    for p in patterns:
        listed |= matches_glob(F.col("path"), p)
    for p in ignore:
        dropped |= matches_glob(F.col("path"), p)
    readable = F.expr("is_valid_utf8(content)") & (F.position(F.lit(b"\x00"), F.col("content")) == 0)
    kind = F.when(dropped, "excluded").when(F.col("content").isNull(), "unreadable").when(listed & readable, "supported").otherwise("unsupported")
    marked = rows.withColumns({"disposition": kind, "folder": F.regexp_replace("path", r"/?[^/]*$", "")})
    markers = marked.where((F.element_at(F.split("path", "/"), -1) == MARKER) & (F.col("disposition") == "supported")).select(F.col("folder").alias("skill"))
    # every folder above a file is a candidate; the nearest with a marker owns it
    above = marked.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("folder", "/"))), lambda i: F.array_join(F.slice(F.split("folder", "/"), F.lit(1), i), "/"))).alias("skill"))
    owner = above.join(markers, "skill").groupBy("path").agg(F.max_by("skill", F.length("skill")).alias("skill"))
    return marked.join(owner, "path", "left").select("path", "disposition", "skill", F.when(F.col("disposition") == "supported", F.decode("content", "UTF-8")).alias("text"))


def front_matter(text: Column) -> dict[str, Column]:
    """name and hint of a file: from its front matter, the hint else from the first line of the body without a colon."""
    head = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    body = F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "")
    field = lambda k: F.nullif(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*[\"']?([^\r\n]*?)[\"']?[ \t]*$", 1), F.lit(""))
    first = F.nullif(F.regexp_extract(body, r"(?m)^[ \t#]*([^:\r\n]*[^:\s])[ \t]*$", 1), F.lit(""))
    return {"name": field("name"), "hint": F.coalesce(field("domain"), first)}


_OPEN = re.compile(r"^\s*<!--\s*kg:uuid=([0-9a-fA-F-]+)((?:\s+\w+=\S+)*)\s*-->\s*$")
_CLOSE = re.compile(r"^\s*<!--\s*/kg(?::uuid=([0-9a-fA-F-]+))?\s*-->\s*$")
_LIKE = re.compile(r"<!--\s*/?kg\b")


def parse_blocks(text: str) -> list[tuple[str, str | None, int, int, str]]:
    """(kind, uuid, first line, last line, body) of a text: blocks, the text outside them, and anomalies (duplicate, orphan close, nested, malformed, unclosed)."""
    out: list[tuple[str, str | None, int, int, str]] = []
    seen: set[str] = set()
    open_at, uuid, body = 0, None, []
    outside, out_at = [], 1

    def leave(line: int) -> None:
        if any(x.strip() for x in outside):
            out.append(("outside", None, out_at, line, "\n".join(outside).strip("\n")))
        outside.clear()

    lines = text.split("\n")
    for k, line in enumerate(lines, 1):
        begin, end = _OPEN.match(line), _CLOSE.match(line)
        if begin:
            if uuid is not None:
                out.append(("nested", begin.group(1), k, k, ""))
                continue
            leave(k - 1)
            uuid, open_at = begin.group(1), k
            if uuid in seen:
                out.append(("duplicate", uuid, k, k, ""))
            seen.add(uuid)
        elif end:
            if uuid is None:
                out.append(("orphan_close", end.group(1), k, k, ""))
                continue
            out.append(("block", uuid, open_at, k, "\n".join(body)))
            uuid, body, out_at = None, [], k + 1
        else:
            if _LIKE.search(line):
                out.append(("malformed", None, k, k, line))
            (body if uuid is not None else outside).append(line)
            if uuid is None and len(outside) == 1:
                out_at = k
    if uuid is not None:
        out.append(("unclosed", uuid, open_at, len(lines), "\n".join(body)))
    else:
        leave(len(lines))
    return out


def blocks(documents: DataFrame, path: str, text: str) -> DataFrame:
    """path, kind, uuid, first_line, last_line, body of all parts of all documents."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(p, *b) for p, t in zip(pdf.path, pdf.text) for b in parse_blocks(t)]
            yield pd.DataFrame(rows, columns=["path", "kind", "uuid", "first_line", "last_line", "body"])

    named = documents.select(F.col(path).alias("path"), F.col(text).alias("text")).where("text is not null")
    return named.mapInPandas(run, "path string, kind string, uuid string, first_line int, last_line int, body string")


def editable_hash(body: Column) -> Column:
    """The hash of what a human may edit, without blanks at line ends and empty lines at the end."""
    return F.sha2(F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), r"(?m)[ \t\r]+$", ""), r"\n+\z", ""), 256)


def classify_edits(parsed: DataFrame, baseline: DataFrame) -> DataFrame:
    """path, uuid, change of each part against the baseline (path, uuid, editable_hash, readonly_hash of the block).

    C1 a block's editable text differs, C2 a block is gone, C3 its fixed part differs or it stands in another document,
    C4 text outside the blocks; blocks as they were are left out.
    """
    own = parsed.where("kind = 'block'").select("path", "uuid", editable_hash(F.col("body")).alias("now"))
    joined = own.join(baseline.select("path", "uuid", F.col("editable_hash").alias("then")), ["path", "uuid"], "full")
    known = baseline.select("uuid").distinct().withColumn("_known", F.lit(True))
    change = F.when(F.col("now").isNull(), "C2").when(F.col("then").isNull(), "C3").when(F.col("now") != F.col("then"), "C1")
    marked = joined.join(known, "uuid", "left").withColumn("change", change).where("change is not null").select("path", "uuid", "change")
    new = parsed.where("kind = 'outside'").select("path", F.lit(None).cast("string").alias("uuid"), F.lit("C4").alias("change"))
    return marked.unionByName(new)


def planned_moves(baseline: DataFrame, present: DataFrame) -> DataFrame:
    """old_path, new_path, state: documents whose blocks are those of a path that is gone; ``move`` where ids and hashes agree and there is one destination, else ``ambiguous``.

    Both tables: path, uuid, editable_hash.
    """
    shape = lambda df: df.groupBy("path").agg(F.array_sort(F.collect_set("uuid")).alias("ids"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("uuid", "editable_hash"))), ","), 256).alias("content"))
    gone = shape(baseline).join(present.select("path").distinct(), "path", "left_anti").withColumnRenamed("path", "old_path")
    fresh = shape(present).join(baseline.select("path").distinct(), "path", "left_anti").withColumnRenamed("path", "new_path").withColumnRenamed("content", "now")
    met = gone.join(fresh, "ids")
    n = met.groupBy("old_path").agg(F.count(F.lit(1)).alias("n"))
    return met.join(n, "old_path").select("old_path", "new_path", F.when((F.col("n") == 1) & (F.col("now") == F.col("content")), "move").otherwise("ambiguous").alias("state"))


def char_chunks(df: DataFrame, key: str, text: str, size: int = 1_800, overlap: int = 200) -> DataFrame:
    """Windows of characters with their lines: key, piece, start_char, end_char, start_line, end_line, text."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - 1 - F.when(n > size, F.lit(overlap)).otherwise(n), F.lit(0)), F.lit(size - overlap))
    rows = df.where(n > 0).select(F.col(key).alias("key"), F.col(text).alias("_t"), F.posexplode(starts).alias("piece", "start_char"))
    end = F.least(F.col("start_char") + size, F.length("_t"))
    part = F.substring(F.col("_t"), F.col("start_char") + 1, F.lit(size))
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    line = lines(F.substring(F.col("_t"), F.lit(1), F.col("start_char"))) + 1
    return rows.select("key", "piece", "start_char", end.alias("end_char"), line.alias("start_line"), (line + lines(part)).alias("end_line"), part.alias("text"))


def token_windows(df: DataFrame, key: str, text: str, size: int = 256, step: int = 224) -> DataFrame:
    """Windows of words: key, piece, first_token, n_tokens, text (words joined by blanks)."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    rows = df.select(F.col(key).alias("key"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1 - F.when(F.size("w") > size, F.lit(size - step)).otherwise(F.size("w")), F.lit(0)), F.lit(step))
    out = rows.select("key", "w", F.posexplode(starts).alias("piece", "first_token"))
    part = F.slice("w", F.col("first_token") + 1, F.lit(size))
    return out.select("key", "piece", "first_token", F.size(part).alias("n_tokens"), F.array_join(part, " ").alias("text"))


def reference_files(paths: DataFrame, path: str) -> DataFrame:
    """skill (the folder above) and path of each file that lies in a folder of references."""
    pattern = rf"^(.*?)/(?:{'|'.join(REFERENCE_DIRS)})/[^/]+(?:/[^/]+)*$"
    return paths.select(F.regexp_extract(path, pattern, 1).alias("skill"), F.col(path).alias("path")).where("skill <> ''").distinct()


def safe_path(path: Column) -> Column:
    """A relative path without backslash, colon, percent or control sign, dot segment, empty segment or outer blank."""
    return F.coalesce((path != "") & ~path.rlike(r"[\\:%\x00-\x1f]|^/|^\s|\s$|(^|/)\.{1,2}(/|$)|//"), F.lit(False))


def render_blocks(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """file_path and text: the blocks of a document's nodes, in order of id, as `parse_blocks` reads them; one row per document. A node without a name has none."""
    body = F.concat_ws("\n", F.concat(F.lit("# "), "name"), F.when(F.coalesce("summary", F.lit("")) != "", F.col("summary")))
    block = F.concat(F.lit("<!-- kg:uuid="), "id", F.lit(" -->\n"), body, F.lit("\n<!-- /kg -->"))
    views = sources.where("file_path <> ''").select(F.col("node_uuid").alias("id"), "file_path").distinct().join(nodes.where("name is not null").select("id", block.alias("block")), "id")
    return views.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "block"))), lambda x: x["block"]), "\n\n").alias("text"))


def sidecar(parsed: DataFrame) -> DataFrame:
    """path, uuid and editable_hash of the blocks of `blocks`: the baseline later edits are told from."""
    return parsed.where("kind = 'block'").select("path", "uuid", editable_hash(F.col("body")).alias("editable_hash"))


def rebound(parsed: DataFrame, baseline: DataFrame) -> DataFrame:
    """path, old_uuid, new_uuid: a block whose id is gone from a document while the same body stands there under an id the document did not have."""
    own = parsed.where("kind = 'block'").select("path", "uuid", editable_hash(F.col("body")).alias("editable_hash"))
    gone = baseline.select("path", "uuid", "editable_hash").join(own.select("path", "uuid"), ["path", "uuid"], "left_anti").withColumnRenamed("uuid", "old_uuid")
    fresh = own.join(baseline.select("path", "uuid"), ["path", "uuid"], "left_anti").withColumnRenamed("uuid", "new_uuid")
    return gone.join(fresh, ["path", "editable_hash"]).select("path", "old_uuid", "new_uuid")


def dispatch(changes: DataFrame) -> DataFrame:
    """`changes` of `classify_edits` with plan: content edits and deletions go past the pipeline (``bypass``), new text goes through it (``pipeline``), changes of what is fixed are refused (``reject``)."""
    return changes.withColumn("plan", F.when(F.col("change").isin("C1", "C2"), "bypass").when(F.col("change") == "C4", "pipeline").otherwise("reject"))


def shared_nodes(views: DataFrame) -> DataFrame:
    """file_path, node_uuid, shared (in two or more files) and primary (the node's first file)."""
    once = views.select("file_path", "node_uuid").distinct()
    many = once.groupBy("node_uuid").agg((F.count(F.lit(1)) >= 2).alias("shared"), F.min("file_path").alias("_first"))
    return once.join(many, "node_uuid").select("file_path", "node_uuid", "shared", (F.col("file_path") == F.col("_first")).alias("primary"))
