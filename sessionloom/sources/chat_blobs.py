"""Chat messages inside key/value blobs, and the folders their workspaces belong to."""

from __future__ import annotations

import json
import sys
from functools import lru_cache

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from sessionloom.operators.scan import ranked

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Which keys hold chats.
CHAT_KEY = "workbench.panel.aichat.view.aichat.chatdata"
CHAT_PREFIXES = ["aiService.prompts", "aiService.generations", "composerData:"]


def _text(value: object) -> str | None:
    return value if isinstance(value, str) and value else None


def messages_in(document: str | None, max_depth: int | None = None) -> list[tuple[str, str]]:
    """(role, text) of every message-shaped object of one document, in document order.

    A document that is no JSON, or nested too deeply for the parser, gives none.
    """
    try:
        open_nodes = [(json.loads(document), 0)] if document else []
    except (ValueError, RecursionError):
        return []
    found: list[tuple[str, str]] = []
    while open_nodes:
        node, depth = open_nodes.pop()
        if isinstance(node, dict):
            role = _text(node.get("role")) or _text(node.get("type"))
            text = _text(node.get("text")) or _text(node.get("content"))
            if role in ("user", "assistant") and text:
                found.append((role, text))
        children = node if isinstance(node, list) else list(node.values()) if isinstance(node, dict) else []
        if max_depth is None or depth < max_depth:
            open_nodes.extend((c, depth + 1) for c in reversed(children) if isinstance(c, (dict, list)))
    return found


@lru_cache(maxsize=None)
def _messages(max_depth: int | None):
    def batch(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [{"role": r, "text": t} for r, t in messages_in(v, max_depth)])

    return F.pandas_udf(batch, ArrayType(StructType([StructField("role", StringType()), StructField("text", StringType())])))


def blob_messages(blobs: DataFrame, max_messages: int | None = None, max_depth: int | None = None) -> DataFrame:
    """``(workspace, pos, role, text)`` from exported blobs (workspace, tbl, key, value).

    The search of a single document runs in Arrow batches; which blobs are read and the
    order across blobs are Spark's. Nothing is left out unless the caller sets how many
    messages a workspace keeps or how deep a document is searched.
    """
    prefixed = F.lit(False)
    for prefix in CHAT_PREFIXES:
        prefixed = prefixed | F.col("key").startswith(prefix)
    item = (F.col("tbl") == "ItemTable") & (F.col("key") == CHAT_KEY)
    wanted = blobs.filter(item | ((F.col("tbl") == "cursorDiskKV") & prefixed))
    rows = wanted.select(
        "workspace", (~item).cast("int").alias("_tbl"), "key", F.posexplode(_messages(max_depth)(F.col("value"))).alias("_at", "m")
    )
    numbered = ranked(rows, ["workspace"], F.struct("_tbl", "key"), [F.col("_at")], "_n")
    if max_messages is not None:
        numbered = numbered.filter(F.col("_n") <= max_messages)
    return numbered.select("workspace", (F.col("_n") - 1).cast("long").alias("pos"), "m.role", "m.text")


def workspace_folders(workspaces: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``(workspace, folder, modified_at)`` from workspace descriptions with a folder URI.

    A drive may follow two slashes or three. Other hosts than this one, encoded slashes and broken escapes give no folder;
    a query or fragment is no part of it.
    """
    uri = F.regexp_replace(F.get_json_object("json", "$.folder"), "^file://([A-Za-z]:/)", "file:///$1")
    path = F.regexp_extract(uri, "^file://(?:(?i:localhost))?(/[^?#]*)", 1)
    path = F.when((F.length(path) > 0) & ~path.rlike("(?i)%2f"), path)
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return (
        (workspaces if max_bytes is None else workspaces.filter(F.octet_length("json") <= max_bytes))
        .filter(uri.startswith("file://"))
        .select("workspace", decoded.alias("folder"), "modified_at")
        .filter(F.col("folder").isNotNull())
    )
