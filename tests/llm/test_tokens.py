"""What the encoder of token ids remembers."""

import numpy as np
import pyarrow as pa

from spanloom.llm import tokens


def test_pieces_of_a_large_vocabulary_are_learnt_once():
    enc = tokens.Encoder(tokens.tokenizer_path(None))
    words = np.char.add(" w", np.arange(150_000).astype(str)).tolist() + np.char.add(" v", np.arange(100_000).astype(str)).tolist()
    texts = pa.array(["".join(words[k : k + 1000]) for k in range(0, len(words), 1000)])
    learnt, learn = [], enc._learn
    enc._learn = lambda new: (learnt.append(len(new)), learn(new))
    parts = [texts.slice(k, 25) for k in range(0, len(texts), 25)]
    first = [x for p in parts for x in enc.encode(p)]
    assert sum(learnt) == len(words) + 1  # and the empty piece before a space
    again = [x for p in parts for x in enc.encode(p)]
    assert sum(learnt) == len(words) + 1  # and the empty piece before a space
    some = texts.slice(240, 5).to_pylist()
    assert all((a == b).all() and (a == c).all() for a, b, c in zip(first[240:245], again[240:245], enc.whole(some), strict=True))


class Counting:
    """The library, with the texts that it has encoded whole."""

    def __init__(self, library):
        self.library, self.model, self.seen = library, library.model, []

    def encode_batch_fast(self, texts, **how):
        self.seen += texts
        return self.library.encode_batch_fast(texts, **how)


def test_words_with_marks_need_the_model_only():
    enc = tokens.Encoder(tokens.tokenizer_path(None))
    texts = ["Now!! pay $$$ at once### größer%%% naïve?! ǅ&&& end...", "Ünter### §!! don't l'été's x'' _a_ b--c 3rd!! ɐ!! ſ*** ÷!!", "many!!!! marks.,;: a.b"]
    want = [x.tolist() for x in enc.whole(texts)]
    enc.library = Counting(enc.library)
    assert [x.tolist() for x in enc.encode(pa.array(texts))] == want
    got = set(enc.library.seen)
    assert not got & {"Now!!", " once###", " größer%%%", " naïve?!", " end...", "Ünter###", " ſ***"}
    assert got >= {" $$$", " §!!", " don't", " b--c", " 3rd!!", " ÷!!", "many!!!!"}


def test_cuts_are_where_pieces_begin():
    texts = ["", " a", "a\n", "", "", "b\nc d", "\n", "é ü", " "]
    whole = pa.array(["skipped x", *texts, "y z"], pa.large_string())
    for some in (whole.slice(1, len(texts)), pa.array(texts, pa.large_string())):
        pieces, counts = tokens.cut(some)
        got = [x.decode() for x in pieces.to_pylist()]
        each = [got[a:b] for a, b in zip(counts[:-1], counts[1:], strict=True)]
        assert each == [t.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") for t in texts]
    assert [len(x) for x in tokens.cut(whole.slice(3, 0))] == [0, 1] and len(tokens.Encoder(tokens.tokenizer_path(None)).encode(whole.slice(4, 2))) == 2
