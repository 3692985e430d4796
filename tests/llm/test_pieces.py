import hashlib
import random

import pytest
from pyspark.sql import functions as F

from riskloom.llm import pieces

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("piece_bpe_32k.model"))

TEXTS = [
    "", " ", "Hello world", "  two  blanks ", "line\none\r\ttab", "café naïve", "日本語 \U0001f600!", "▁x▁", "a\x00b", "x" * 300, "\n\n \n",
    "aaa bbb the of and in er on",
]


def brute(codec, text):
    """Dynamic programme over all substrings, by end and from long to short."""
    by_text = {codec_piece: (i, s) for codec_piece, (n, i, s) in codec.automaton.items()}
    longest = max(map(len, by_text))
    best, back = [0.0] + [float("-inf")] * len(text), [None] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - longest), end):
            i, s = by_text.get(text[start:end], (None, None))
            if i is None:
                if end - start > 1:
                    continue
                i, s = -1, codec.unknown
            if best[start] + s > best[end]:
                best[end], back[end] = best[start] + s, (start, i)
    out, at = [], len(text)
    while at:
        start, i = back[at]
        out.append([i] if i >= 0 else [codec.byte_ids[b] for b in text[start:at].encode()])
        at = start
    return [i for part in reversed(out) for i in part]


def ids_of(codec, text):
    raw = codec.encode(text)
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


def random_texts(n):
    rng = random.Random(9)
    chars = list("abcdehinorst  \n.,") + ["é", "€", "中"]
    return ["".join(rng.choices(chars, k=rng.randint(1, 60))) for _ in range(n)]


def test_ids_equal_brute_force_and_decode_back():
    codec = pieces.load(PATH)
    for text in TEXTS + random_texts(150):
        got = ids_of(codec, text)
        assert got == (brute(codec, "▁" + text.replace(" ", "▁")) if text else []), text
        assert codec.decode(got) == text.replace("▁", " ")


def test_ids_equal_the_library_with_unigram_scoring(tmp_path):
    model_pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    proto = model_pb2.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = model_pb2.TrainerSpec.UNIGRAM
    for p in proto.pieces:  # the library adds in single precision
        p.score = max(p.score, -40_000.0)
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    library, codec = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.load(str(path))
    for text in TEXTS + random_texts(300):
        assert ids_of(codec, text) == library.encode(text), text


def test_documents_round_trip(docs_of):
    texts = dict(enumerate(TEXTS)) | {50: None, 51: "long " * 30_000}
    docs = docs_of([*texts.items(), (0, "again")])
    back = pieces.decode(pieces.encode(docs, PATH), PATH).withColumn("sha", F.sha2("text", 256)).collect()
    got = {(r.doc_id, r.sha) for r in back}
    want = {(i, hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest()) for i, t in [*texts.items(), (0, "again")]}
    assert got == want
    assert pieces.encode(docs_of([]), PATH).count() == 0


def test_pieces_across_blanks_keep_the_text_whole():
    codec = pieces.PieceCodec([None, ("a", -1.0), ("▁", -1.0), ("a▁a", -0.5), ("▁a", -1.5), *[None] * 256], list(range(5, 261)))
    assert ids_of(codec, "a a") == [2, 3]
