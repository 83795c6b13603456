"""Ids and hashes that depend on content alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace of node ids (a parameter everywhere it is used).
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def node_uuid(members: Column, namespace: str = NAMESPACE) -> Column:
    """The id of a node: of its sorted distinct members joined by commas; members with a comma are framed as JSON in a namespace of their own."""
    clean = F.array_sort(F.array_distinct(F.filter(members, lambda m: F.coalesce(m, F.lit("")) != "")))
    framed = F.exists(clean, lambda m: F.contains(m, F.lit(",")))
    return F.when(framed, uuid5(uuid_of(namespace, "framed"), F.to_json(clean))).otherwise(uuid5(namespace, F.array_join(clean, ",")))


def uuid_of(namespace: str, name: str) -> str:
    import uuid

    return str(uuid.uuid5(uuid.UUID(namespace), name))


def unit_id(skill: Column, tag: Column, name: Column, content: Column, detail: Column) -> Column:
    """Readable id of an annotated unit with the hash of all it says."""
    from weftgraph.functions.text import slug

    parts = [F.coalesce(c, F.lit("")) for c in (skill, tag, name, content, detail)]
    return F.concat_ws("-", slug(parts[0]), parts[1], slug(parts[2]), F.substring(F.sha2(F.to_json(F.array(*parts)), 256), 1, 12))


def semantic_key(label: Column, name: Column, summary: Column, description: Column, members: Column) -> Column:
    return F.to_json(F.array(label, name, summary, description, F.array_join(F.array_sort(members), ",")))


def fnv1a32(c: Column) -> Column:
    """FNV-1a over the characters of a text, as a number."""
    prime, mask = F.lit(16777619).cast("long"), F.lit(0xFFFFFFFF).cast("long")
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    step = lambda h, x: (h.bitwiseXOR(_code(x)) * prime).bitwiseAND(mask)
    return F.aggregate(chars, F.lit(2166136261).cast("long"), step)


def _code(x: Column) -> Column:
    """The code point of a one-character text."""
    return F.conv(F.hex(F.encode(x, "UTF-32")), 16, 10).cast("long")


def file_slug(name: Column) -> Column:
    """A file name of at most 40 bytes; names without usable signs get one from their hash."""
    s = F.regexp_replace(F.lower(name), r"[^a-z0-9-]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, r"-{2,}", "-"), r"^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, 40), r"-+$", "")
    return F.when(s != "", s).otherwise(F.concat(F.lit("node-"), F.lower(F.hex(fnv1a32(name)))))


def repository_identity(url: Column) -> Column:
    """``git:host/path`` of https, ssh and scp forms of an address."""
    u = F.trim(url)
    scp = F.regexp_replace(u, r"^(?:[^@/]+@)?([^:/]+):(?!//)(.+)$", "$1/$2")
    bare = F.regexp_replace(F.regexp_replace(F.when(F.contains(u, F.lit("://")), u).otherwise(scp), r"^[a-z+]+://(?:[^@/]+@)?", ""), r"(?:\.git)?/*$", "")
    host = F.lower(F.regexp_replace(F.split(bare, "/", 2)[0], r":\d+$", ""))
    return F.concat(F.lit("git:"), host, F.lit("/"), F.split(bare, "/", 2)[1])


def table_identity(df, columns: list[str] | None = None):
    """One row with the digest of a table's rows, whatever their order: hashes are combined, never gathered."""
    columns = columns or df.columns
    row = F.md5(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))
    part = lambda k: F.conv(F.substring(row, k, 15), 16, 10).cast("long")
    sums = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(part(1)).alias("x1"), F.bit_xor(part(16)).alias("x2"), F.sum(F.pmod(part(1), F.lit(1 << 31))).alias("s1"))
    return sums.select("n", F.sha2(F.concat_ws("|", "n", "x1", "x2", "s1"), 256).alias("digest"))


def rfc3339_nano(ts: Column) -> Column:
    """A time as a version stamp: with as many digits of the second as are not zero, in UTC."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.lit("Z"))


def djb2(c: Column) -> Column:
    """The djb2 hash of a text's characters, modulo 2^32."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(5381).cast("long"), lambda h, x: (h * 33 + _code(x)).bitwiseAND(mask))


def canonical_json(*columns: str) -> Column:
    """The columns as one compact JSON object with sorted keys; nulls are kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def relation_hash(source: Column, target: Column, kind: Column, description: Column) -> Column:
    """The identity of a relation: the SHA-256 of its fields as a JSON list."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(c, F.lit("")) for c in (source, target, kind, description)])), 256)
