"""Chat formatting by token-level assembly.

A turn is <|im_start|> role <|im_sep|> text <|im_end|>. Role and text are encoded apart from each other
and from the marks, whose reserved ids are spliced in, so no text can yield a mark. The loss mask is
the prefix sum of +1 at the start and -1 at the end of assistant texts. Where a control string (of this
or of other templates) occurs in a role or text, a backslash is put after its first character, besides
those that stand there already; taking one away again gives the text back exactly.

Defined cases: a null text or role counts as empty; rows of a conversation go by turn, ties by role and
text, a null turn first; rows without conv_id form one conversation; only the role "assistant" is
learned; repeated rows are turns like any other; an empty table has no conversations; extra columns are
ignored.

Encoding, and reading back, are maps over turns, so the turns of one long conversation (or of all rows without
conv_id) are spread over all tasks. What follows in the order of a conversation is a sum or a hash over its
turns, in one streamed pass with bounded memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.runtime import prepare

#: Marks, in the order of their reserved ids after the vocabulary.
MARKS = ["<|im_start|>", "<|im_sep|>", "<|im_end|>"]
LEARNED = "assistant"
#: Control strings: a first character, then one of these.
_BODY = r"\|\w+\|>|/?s>|/?INST\]|</?SYS>>|/?(?:bos|eos|start_of_turn|end_of_turn)>"
_PLAIN = re.compile(rf"([<\[])(\\*)({_BODY})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_BODY})")


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


class Template:
    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first = max(ranks.values()) + 1
        self.start, self.sep, self.end = range(self.first, self.first + len(MARKS))
        self.after = np.array([self.end], np.int32)
        self.roles: dict[str, np.ndarray] = {}  # heads by role

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a turn and their loss mask."""
        if role not in self.roles:
            if len(self.roles) > 1000:
                self.roles.clear()
            self.roles[role] = np.array([self.start, *self.encoding.encode_ordinary(escape(role)), self.sep], np.int32)
        head, body = self.roles[role], self.encoding.encode_to_numpy(escape(text)).astype(np.int32)
        ids = np.concatenate([head, body, self.after])
        change = np.zeros(len(ids) + 1, np.int8)
        if role == LEARNED:
            change[len(head)] += 1
            change[len(head) + len(body)] -= 1
        return ids, np.cumsum(change, dtype=np.int8)[:-1]

    def text(self, ids) -> str:
        return self.encoding.decode_bytes(ids).decode("utf-8", "surrogatepass")

    def read(self, ids, mask) -> tuple[str, str, str, str]:
        """Role, text, text under the mask, and the formatted text, from a turn's ids."""
        ids, mask = np.asarray(ids, np.int32), np.asarray(mask, bool)
        sep = int(np.argmax(ids == self.sep))
        role, body = self.text(ids[1:sep].tolist()), self.text(ids[sep + 1 : -1].tolist())
        loss = self.text(ids[mask].tolist()) if mask.any() else ""
        return unescape(role), unescape(body), unescape(loss), f"{MARKS[0]}{role}{MARKS[1]}{body}{MARKS[2]}"


_loaded: dict[str, Template] = {}


def _template(path: str) -> Template:
    if path not in _loaded:
        _loaded[path] = Template(path)
    return _loaded[path]


_ORDER = ["conv_id", "turn", "role", "text"]


def _kinds(df: DataFrame) -> tuple[str, str]:
    return df.schema["conv_id"].dataType.simpleString(), df.schema["turn"].dataType.simpleString()


def _in_order(rows: DataFrame) -> DataFrame:
    """Conversations together and in order within a partition."""
    return rows.repartition(F.col("conv_id")).sortWithinPartitions(*_ORDER)


def encoded(conversations: DataFrame, vocab: str) -> DataFrame:
    """One row per turn, in no order: conv_id, turn, role, text, ids, loss_mask. A map."""
    prepare(conversations.sparkSession)
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]

    def run(batches):
        template = _template(vocab)
        for batch in batches:
            ids, masks, ends = [np.zeros(0, np.int32)], [np.zeros(0, np.int8)], [0]
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                i, m = template.turn(role, text)
                ids.append(i)
                masks.append(m)
                ends.append(ends[-1] + len(i))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in (ids, masks)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*_ORDER, "ids", "loss_mask"])

    conv, turn = _kinds(conversations)
    rows = conversations.select("conv_id", "turn", *texts)
    return rows.mapInArrow(run, f"conv_id {conv}, turn {turn}, role string, text string, ids array<int>, loss_mask array<tinyint>")


def turns(conversations: DataFrame, vocab: str) -> DataFrame:
    """One row per turn, conversations together and in order within a partition: conv_id, turn, offset, ids, loss_mask.

    ``offset`` is the number of ids before the turn in its conversation.
    """
    conv, turn = _kinds(conversations)

    def run(batches):
        last, offset = (), 0
        for batch in batches:
            offsets = []
            for c, n in zip(batch.column(0).to_pylist(), batch.column(4).value_lengths().to_pylist()):
                if last != (c,):
                    last, offset = (c,), 0
                offsets.append(offset)
                offset += n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(offsets, pa.int64()), batch.column(4), batch.column(5)], ["conv_id", "turn", "offset", "ids", "loss_mask"])

    return _in_order(encoded(conversations, vocab)).mapInArrow(run, f"conv_id {conv}, turn {turn}, offset long, ids array<int>, loss_mask array<tinyint>")


def read_back(formatted: DataFrame, vocab: str) -> DataFrame:
    """conv_id, turn, role, text, loss (text under the mask; null where it is the whole text) and formatted_chars of rows with ids and loss_mask. A map."""
    conv, turn = _kinds(formatted)
    names = ["conv_id", "turn", "role", "text", "loss", "formatted_chars"]

    def run(batches):
        template = _template(vocab)
        for batch in batches:
            found = []
            for column in (batch.column(2), batch.column(3)):
                flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
                found.append([flat[a:b] for a, b in zip(at - at[0], at[1:] - at[0])])
            read = [template.read(ids, mask) for ids, mask in zip(*found)]
            roles, texts, losses, whole = zip(*read) if read else ((), (), (), ())
            losses = [None if x == t else x for x, t in zip(losses, texts)]
            arrays = [*(pa.array(x, pa.string()) for x in (roles, texts, losses)), pa.array(map(len, whole), pa.int64(), size=len(whole))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names)

    rows = formatted.select("conv_id", "turn", "ids", "loss_mask")
    return rows.mapInArrow(run, f"conv_id {conv}, turn {turn}, role string, text string, loss string, formatted_chars long")


def digests(formatted: DataFrame, vocab: str) -> DataFrame:
    """Per conversation, read back from rows with ids and loss_mask: counts and digests."""
    kind, _ = _kinds(formatted)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        open_ = None

        def closed(state) -> tuple:
            conv, n, seen, chars, loss, length = state
            return conv, n, seen.hexdigest(), chars, loss.hexdigest(), length

        def table(done: list[tuple], id_type) -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 6
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        id_type = None
        for batch in batches:
            done, id_type = [], batch.schema.field(0).type
            for conv, role, text, loss, chars in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if open_ is None or open_[0] != conv:
                    if open_:
                        done.append(closed(open_))
                    open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                loss = text if loss is None else loss
                open_[1] += 1
                open_[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                open_[3] += len(loss)
                open_[4].update(loss.encode("utf-8", "surrogatepass"))
                open_[5] += chars
            yield table(done, id_type)
        if open_:
            yield table([closed(open_)], id_type)

    return _in_order(read_back(formatted, vocab)).mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted(conversations: DataFrame, vocab: str) -> Iterator[str]:
    """The formatted texts, turn by turn, for small tables and tests."""
    template = _template(vocab)
    for row in turns(conversations, vocab).toLocalIterator():
        yield template.read(row["ids"], row["loss_mask"])[3]
