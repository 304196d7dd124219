"""Mail messages as rows."""

from __future__ import annotations

from collections.abc import Iterator
from email import message_from_bytes, policy
from email.utils import parseaddr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SCHEMA = "path string, message_id string, sender string, subject string, text string, attachments array<struct<name:string,type:string,bytes:long>>"


def _parse(raw: bytes) -> tuple:
    message = message_from_bytes(raw, policy=policy.default)
    texts, marked, attached = [], [], []
    for part in message.walk():
        if part.is_multipart():
            continue
        kind, name = part.get_content_type(), part.get_filename()
        if name or part.get_content_disposition() == "attachment":
            attached.append({"name": name, "type": kind, "bytes": len(part.get_payload(decode=True) or b"")})
        elif kind in ("text/plain", "text/html"):
            body = (part.get_payload(decode=True) or b"").decode(_charset(part), "replace").replace("\r\n", "\n")
            (texts if kind == "text/plain" else marked).append(body)
    sender = parseaddr(str(message.get("From", "")))[1].lower() or None
    return message.get("Message-ID"), sender, message.get("Subject"), "\n".join(texts) if texts else None, "\n".join(marked), attached


def _charset(part) -> str:
    import codecs

    try:
        return codecs.lookup(part.get_content_charset() or "utf-8").name
    except LookupError:
        return "utf-8"


def messages(rows: DataFrame) -> DataFrame:
    """One row a file of (path, content): sender, subject, text and attachments.

    Plain text is preferred, HTML is reduced to text; forwarded messages inside
    are part of the text. What is missing is null; nothing is dropped.
    """
    kind = pa.schema([
        ("path", pa.string()), ("message_id", pa.string()), ("sender", pa.string()), ("subject", pa.string()), ("text", pa.string()), ("markup", pa.string()),
        ("attachments", pa.list_(pa.struct([("name", pa.string()), ("type", pa.string()), ("bytes", pa.int64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = (path, *_parse(raw.as_py() or b""))
                plain = [v if v is None or isinstance(v, (list, str)) else str(v) for v in row]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(plain, kind)], schema=kind)

    out = rows.select("path", "content").mapInArrow(run, SCHEMA.replace("text string,", "text string, markup string,"))
    return out.withColumn("text", F.coalesce("text", T.html_text(F.col("markup")))).drop("markup")


def allowed(mail: DataFrame, senders: DataFrame) -> DataFrame:
    """The messages whose sender, or `@domain`, is an `entry`: two semi-joins' worth
    of keys in one."""
    entries = senders.select(F.lower("entry").alias("entry")).distinct()
    keyed = mail.withColumn("_keys", F.array("sender", F.concat(F.lit("@"), F.substring_index("sender", "@", -1))))
    named = keyed.select("path", F.explode("_keys").alias("entry")).join(entries, "entry", "left_semi").select("path").distinct()
    return mail.join(named, "path", "left_semi")


def once(mail: DataFrame, key: bytes) -> DataFrame:
    """One message a Message-ID (the smallest path); those without are told apart by path."""
    mark = T.keyed_hash(F.coalesce("message_id", F.concat(F.lit("path:"), "path")), key)
    keyed = mail.withColumn("message_key", mark)
    first = keyed.groupBy("message_key").agg(F.min("path").alias("path"))
    return keyed.join(first, ["message_key", "path"], "left_semi")
