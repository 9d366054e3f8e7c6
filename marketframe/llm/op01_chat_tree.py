"""Chat formatting as a prefix tree.

Each turn becomes a segment: marks of its role around its text, in which control strings are escaped by one
backslash after their first character and read back by taking one away.  Conversations that share their first
turns share the segments' nodes.  A shard is a range of conversations in the order of their paths; in it every node's
tokens appear once, depth first, with ``start`` (place in the shard), ``position`` (tokens before it on its path, so
that its position ids are position, position + 1, ...), ``subtree_end``, and ``attends``: the intervals of the shard
that hold its ancestors, neighbours merged.  Only assistant texts are under the loss mask.

A node's key is a hash chained over the turns, so a conversation's turns pass through one task in order, as a stream,
and are never gathered; its path holds 16 bytes per turn.  Shards are cut at any place of the order; the ancestors that
a shard's first conversation shares with the shard before are repeated in it, so that a shard stands alone.

Defined cases: null role or text is empty; turns are ordered by turn (null first), then role and text, and a
repeated row is a turn of its own; rows without conv_id form one conversation without an id; an empty table
gives an empty tree; columns besides conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm import words
from marketframe.operators.landing import land

SHARD_TOKENS = 1 << 20
# The marks of the template by role; other roles are named between <|role|> and <|text|>.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
NAMED = ("<|role|>", "<|text|>", "<|end|>")
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", *NAMED]
_PLAIN = re.compile("|".join(f"({re.escape(c[0])})(\\\\*)({re.escape(c[1:])})" for c in CONTROL))
_MARK = re.compile("|".join(map(re.escape, CONTROL)))


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: (g := [x for x in m.groups() if x is not None])[0] + "\\" + g[1] + g[2], text)


def unescape(text: str) -> str:
    return _PLAIN.sub(lambda m: (g := [x for x in m.groups() if x is not None])[0] + g[1][1:] + g[2], text)


def segment(role: str, text: str) -> tuple[str, str, str]:
    """What stands before a turn's text, the escaped text, and what stands after it."""
    if role in MARKS:
        return MARKS[role][0], escape(text), MARKS[role][1]
    return NAMED[0] + escape(role) + NAMED[1], escape(text), NAMED[2]


def read_back(formatted: str) -> tuple[str, str]:
    """Role and text of a segment."""
    mark = _MARK.match(formatted).group()
    for role, (before, after) in MARKS.items():
        if mark == before.strip():
            return role, unescape(formatted[len(before):len(formatted) - len(after)])
    role_end = formatted.index(NAMED[1])
    return unescape(formatted[len(NAMED[0]):role_end]), unescape(formatted[role_end + len(NAMED[1]):len(formatted) - len(NAMED[2])])


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_CHAIN = pa.schema([("conv_id", pa.int64()), ("idx", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("formatted", pa.string()),
                    ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("token_ids", pa.list_(pa.int32())), ("loss_tokens", pa.list_(pa.int32()))])
CHAIN = """conv_id long, idx long, key binary, parent binary, formatted string, loss_start int, loss_end int,
    token_ids array<int>, loss_tokens array<int>"""


def _chain(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        current, idx, key = object(), 0, b""
        for batch in words.slices(batches):
            out = []
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if conv_id != current:
                    current, idx, key = conv_id, 0, b""
                role, text, parent = role or "", text or "", key
                key = hashlib.blake2b(b"%b%d\n%b\n%b" % (parent, len(role), role.encode(), text.encode()), digest_size=16).digest()
                before, body, after = segment(role, text)
                tokens = [encode(x) for x in (before, body, after)]
                loss = role == "assistant"
                out.append((conv_id, idx, key, parent, before + body + after, len(before) if loss else 0, len(before + body) if loss else 0,
                            sum(tokens, []), [len(tokens[0]), len(tokens[0]) + len(tokens[1])] if loss else [0, 0]))
                idx += 1
            yield words.batch_of(_CHAIN, *(zip(*out) if out else [[]] * len(_CHAIN)))

    return run


def chained(turns: DataFrame, path: str | None = None) -> DataFrame:
    """One row per turn: its place in its conversation, its node's key and parent, and its segment."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text") \
        .mapInArrow(_chain(path or tokenizer_path()), CHAIN)


LAYOUT = """shard int, key binary, depth int, start long, n_tokens long, position long, subtree_end long,
    attends array<struct<start:long,end:long>>, conversations long"""
_LAYOUT = pa.schema([("shard", pa.int32()), ("key", pa.binary()), ("depth", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                     ("position", pa.int64()), ("subtree_end", pa.int64()),
                     ("attends", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("conversations", pa.int64())])


def _lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, at = TaskContext.get().partitionId(), 0
    stack: list[dict] = []

    def close(depth: int) -> list[tuple]:
        done = []
        while len(stack) > depth:
            node = stack.pop()
            done.append((shard, node["key"], len(stack), node["start"], node["n"], node["position"], at, node["attends"], node["conversations"]))
        return done

    for batch in words.slices(batches):
        out = []
        for path, conversations in zip(batch.column(0), batch.column(1).to_pylist()):
            path = path.as_py()
            shared = 0
            while shared < min(len(path), len(stack)) and stack[shared]["key"] == path[shared]["key"]:
                shared += 1
            out += close(shared)
            for step in path[shared:]:
                attends, position = [], 0
                if stack:
                    up = stack[-1]
                    attends, position = list(up["attends"]), up["position"] + up["n"]
                    end = up["start"] + up["n"]
                    if attends and attends[-1]["end"] == up["start"]:
                        attends[-1] = {"start": attends[-1]["start"], "end": end}
                    else:
                        attends.append({"start": up["start"], "end": end})
                stack.append({"key": step["key"], "start": at, "n": step["n"], "position": position, "attends": attends, "conversations": 0})
                at += step["n"]
            stack[-1]["conversations"] += conversations
        if out:
            yield words.batch_of(_LAYOUT, *zip(*out))
    if stack:
        yield words.batch_of(_LAYOUT, *zip(*close(0)))


def paths_of(chain: DataFrame) -> DataFrame:
    """(conv_id, path): the nodes of a conversation in order, as (idx, key, n)."""
    return chain.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("idx", "key", F.size("token_ids").cast("long").alias("n")))).alias("path"))


def prefix_tree(chain: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The nodes of all shards: where their tokens stand and what they attend to, with segment, tokens and loss mask."""
    nodes = chain.select("key", "parent", "formatted", "loss_start", "loss_end", "token_ids", "loss_tokens").dropDuplicates(["key"])
    paths = land(paths_of(chain).withColumn("leaf", F.element_at("path", -1)["key"]).groupBy("leaf")
                 .agg(F.first("path").alias("path"), F.count("*").alias("conversations")).select("path", "conversations"))
    tokens = paths.agg(F.sum(F.aggregate("path", F.lit(0).cast("long"), lambda s, x: s + x["n"]))).first()[0] or 0
    laid = paths.repartitionByRange(max(1, ceil(tokens / shard_tokens)), "path").sortWithinPartitions("path").mapInArrow(_lay_out, LAYOUT)
    return land(laid).join(nodes, "key")


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = None
    for batch in words.slices(batches):
        out = []
        for conv_id, formatted, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            if state is None or state[0] != conv_id:
                out += [state] if state else []
                state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = read_back(formatted)
            learned = unescape(formatted[start:end])
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            state[3] += len(learned)
            state[4].update(learned.encode())
            state[5] += len(formatted)
        if out:
            yield _finished(out)
    if state:
        yield _finished([state])


def _finished(rows: list) -> pa.RecordBatch:
    return words.batch_of(_DIGEST, *zip(*((c, n, t.hexdigest(), k, loss.hexdigest(), f) for c, n, t, k, loss, f in rows)))


def digests(chain: DataFrame, tree: DataFrame) -> DataFrame:
    """Per conversation, what its path in the tree says, read back from the segments."""
    segments = tree.select("key", "formatted", "loss_start", "loss_end").dropDuplicates(["key"])
    return chain.select("conv_id", "idx", "key").join(segments, "key").repartition("conv_id").sortWithinPartitions("conv_id", "idx") \
        .select("conv_id", "formatted", "loss_start", "loss_end") \
        .mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op1_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").union(extra)
    chain = land(chained(turns))
    return digests(chain, prefix_tree(chain))


QUERIES = {"op1_chat_tree": op1_chat_tree}
ORACLES: dict[str, str] = {
    "op1_chat_tree": """
        WITH t AS (
            SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        f AS (
            SELECT *, regexp_replace(text, '(<)(\\\\*)(s>|/s>|<SYS>>|</SYS>>|\\|role\\|>|\\|text\\|>|\\|end\\|>)|(\\[)(\\\\*)(INST\\]|/INST\\])',
                '\\1\\4\\\\\\2\\5\\3\\6', 'g') AS body FROM t)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(COALESCE(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
            CAST(sum(length(body) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 23 + length(role) END) AS BIGINT)
                AS formatted_chars
        FROM f GROUP BY conv_id""",
}
