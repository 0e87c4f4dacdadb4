"""Offsets, decoding and resynchronisation against the libraries and plain definitions."""

import hashlib
import random
import unicodedata

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from test_operators import frame
from tokenizers import Tokenizer

from tessella.llm import tokens

TEXTS = ["", None, "the cat's 12 hats", "漢字 and é́ 😀😀 x", "🧬" * 30, "a" * 3000 + "é" * 100, "  \n\t  ", "ЖЯ ΣΑΣ"]


def test_ids_offsets_and_round_trip(spark):
    ranks = tokens.read_ranks(public_tokenizers.path(tokens.BYTE_RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs, token = frame(spark, TEXTS), {i: t for t, i in ranks.items()}
    made = tokens.encode(docs)
    got, back = {r.doc_id: r for r in made.collect()}, {r.doc_id: bytes(r.bytes) for r in tokens.decode(made).collect()}
    digests = {r.doc_id: r for r in tokens.byte_round_trip(docs).collect()}
    for i, text in enumerate(t or "" for t in TEXTS):
        assert got[i].ids == library.encode_ordinary(text) and back[i] == text.encode()
        at, places, owners = 0, [], [k for k, c in enumerate(text) for _ in c.encode()]
        for x in got[i].ids:
            places.append((owners[at], owners[at + len(token[x]) - 1] + 1))
            at += len(token[x])
        assert list(zip(got[i].starts, got[i].ends)) == places
        split = sum(e > s for (_, e), (s, _) in zip(places, places[1:]))
        d, sha = digests[i], lambda x: hashlib.sha256(x).hexdigest()
        assert (d.n_tokens, d.n_split) == (len(places), split) and d.decoded_sha256 == sha(text.encode())
        assert d.ids_sha256 == sha(" ".join(map(str, got[i].ids)).encode())
        assert d.offsets_sha256 == sha(b"".join(p[k].to_bytes(4, "little") for k in (0, 1) for p in places))
    assert tokens.encode(docs.limit(0)).count() == 0 and tokens.decode(made.limit(0)).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"ae漢ЖΣ", "́", "̣", "ᄀ", "ᅡ", "ᆨ", "가", "Ą", "゙", "か", "ा", "ে", "Å", "﨑"]), max_size=12).map("".join))
def test_normalisation_never_reaches_across_a_stable_place(text):
    nfc = lambda x: unicodedata.normalize("NFC", x)
    assert all(nfc(text[:p]) + nfc(text[p:]) == nfc(text) for p in range(len(text)) if tokens._stable(text, p))


@pytest.mark.parametrize("letters", ["абвгдежз", "漢字仮名交文", "ابتثجح", "abcdéè"])
def test_chunks_of_any_script_stay_short(letters, monkeypatch):
    word, rng = Tokenizer.from_file(public_tokenizers.path(tokens.WORD_VOCAB)), random.Random(3)
    text = "".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) + rng.choice([" ", "。", ", "]) for _ in range(8000))
    sizes = []

    class Watched:
        def encode(self, text, **options):
            sizes.append(len(text))
            return word.encode(text, **options)

    assert tokens.resynchronised_count(Watched(), text, 2000, 100) == len(word.encode(text, add_special_tokens=False).ids)
    assert max(sizes) <= 2000 and sum(sizes) < 1.2 * len(text)


def test_long_pieces_are_not_remembered():
    word = Tokenizer.from_file(public_tokenizers.path(tokens.WORD_VOCAB))
    encoder = tokens.lower_case_encoder(word, len)
    assert sum(encoder.values("b" * 5000 + " cat " + "b" * 5000)) == len(word.encode("b" * 5000 + " cat " + "b" * 5000, add_special_tokens=False).ids)
    assert max(map(len, encoder.kept)) <= 64
