"""Alignment of two tokenizers against the libraries' tokens of whole texts, compared byte by byte."""

import hashlib
from collections import Counter, defaultdict

import pytest
from conftest import LONG, SCHEMA, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from datumloom.llm import token_alignment as ta
from datumloom.llm.tokens import byte_characters, tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))


BYTE_OF = {c: i for i, c in enumerate(byte_characters())}


def by_hand(libraries, text):
    """Groups as text and all linked pairs, or None without tokens."""
    a, b = libraries
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(BYTE_OF[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return None
    groups, links, i, j, at_a, at_b = [], [], 0, 0, 0, 0
    group_a, group_b = [], []
    while i < len(ids_a) or j < len(ids_b):
        if at_a <= at_b:
            at_a += len(bytes_a[i])
            group_a.append((ids_a[i], at_a - len(bytes_a[i]), at_a))
            i += 1
        else:
            at_b += len(bytes_b[j])
            group_b.append((ids_b[j], at_b - len(bytes_b[j]), at_b))
            j += 1
        if at_a == at_b:
            groups.append(",".join(str(x[0]) for x in group_a) + "|" + ",".join(str(x[0]) for x in group_b))
            links += [(x[0], y[0]) for x in group_a for y in group_b if x[1] < y[2] and y[1] < x[2]]
            group_a, group_b = [], []
    return len(ids_a), len(ids_b), groups, links


def figures(libraries, rows):
    found = [(doc_id, by_hand(libraries, text)) for doc_id, text in rows]
    count = Counter(p for _, f in found if f for p in set(f[3]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for doc_id, f in found:
        if f is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


ODD = [
    "a  b   c",
    "tabs\tand\r\nlines\n\n  indented();\r\n",
    " leading and trailing \n ",
    "\n\nstarts with lines",
    "<|endoftext|> and <s> are plain text",
    "a b 　c \x1c d \x85 e f",
    "literal ▁ mark",
    "don't we'll 's 12345 ... ---",
    "日本語のテキスト with Ünïcödé 🙂🏽 ́",
    "\x00\x01 null",
    " ",
    "\t",
    "x" * 5000,
]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(libraries, text):
    columns = ta.Aligner(tokenizer_path(A), tokenizer_path(B)).batch([text, "between", text])
    expected = by_hand(libraries, text)
    digest = hashlib.sha256(";".join(expected[2]).encode()).hexdigest() if expected else ""
    sizes = (expected[0], expected[1], len(expected[2]), len(expected[3])) if expected else (0, 0, 0, 0)
    for i in (0, 2):
        assert columns["groups_sha256"][i].as_py() == digest
        assert tuple(columns[c][i].as_py() for c in ("n_a", "n_b", "n_groups", "n_links")) == sizes
        pairs = Counter(a * 32000 + b for a, b in expected[3]) if expected else {}
        assert dict(zip(columns["pairs"][i].as_py(), columns["times"][i].as_py())) == pairs


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab ' s\n\t\r\vé日 ▁1.;)(  \x1c🙂") | st.characters(exclude_categories=["Cs"]), max_size=30), max_size=6))
def test_any_texts(libraries, texts):
    aligner = ta.Aligner.of(tokenizer_path(A), tokenizer_path(B))
    columns = aligner.batch(texts)
    for i, text in enumerate(texts):
        expected = by_hand(libraries, text)
        assert columns["groups_sha256"][i].as_py() == (hashlib.sha256(";".join(expected[2]).encode()).hexdigest() if expected else "")


def test_figures_of_the_given_documents_and_odd_rows(spark, documents, odd_rows, libraries):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert got(ta.link_figures(documents.repartition(5))) == figures(libraries, rows)
    odd = [(r[0], r[1]) for r in odd_rows] + list(enumerate(ODD, 100))
    assert got(ta.link_figures(spark.createDataFrame(list(odd_rows) + rows_of(enumerate(ODD, 100)), SCHEMA))) == figures(libraries, odd)
    assert LONG in [t for _, t in odd]


def test_counts_too_many_to_broadcast(spark, documents, monkeypatch):
    small = documents.where("n_chars < 2000")
    expected = got(ta.link_figures(small))
    monkeypatch.setattr(ta, "BROADCAST_PAIRS", 0)
    assert got(ta.link_figures(small.repartition(7))) == expected


def test_an_empty_table_gives_nothing(none):
    assert got(ta.link_figures(none)) == []
