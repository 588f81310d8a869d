"""Small tables with every edge case, for the tests of this folder."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

DOC = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}
TABLES = {
    "documents": DOC, "labels": {"doc_id": pa.int64(), "quality": pa.int32(), "toxic": pa.int32()},
    "pages": {"page_id": pa.int64(), "url": pa.string(), "html": pa.string()},
    "conversations": {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string()},
    "benchmark": {"item_id": pa.int64(), "text": pa.string()},
}
# Names that operators use for their results or might use inside.
CLASH = ("size", "shard", "slot", "law", "score", "lang_pred", "held_out", "fp", "fingerprint", "root", "component_id", "kept", "n_words",
         "n_hit", "hash", "words", "n", "count", "key", "position", "target", "u", "v", "copy", "rule", "tag", "seq", "op", "part")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = ["".join(random.Random(i).choices("abcdefghijklmnoprstuvz", k=2 + i % 7)) for i in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


def documents():
    """Nulls in every column, empty, blank and very long texts, repeated rows, copies, shared passages, hits."""
    item = prose("item", 30)
    passage = prose("passage", 60)
    long = prose("long", 30_000, 5000)
    texts = [
        None, "", " \t\n\x0b", "A", "a", "one two three", "One  two\tTHREE", "1234 5678 !!", "日本語 の テキスト ですか", "É è È",
        prose(1, 300), prose(1, 300), prose(1, 300).upper(), prose(1, 299) + " changed", prose(2, 200) + " " + passage + " " + prose(3, 100),
        passage + " " + prose(4, 80), prose(5, 50) + "\n" + item + "\n" + prose(6, 40), " ".join(item.split()[3:14]), " ".join(item.split()[3:12]),
        "same same " * 200, "line of words here\n" * 40, "w " * 3 + "# * $ % & | < >", "short item here", prose(7, 12), prose(8, 13), prose(8, 13) + " x",
        prose(9, 90) + " " + prose(10, 20), long, long + " " + passage, "\\N", "|", prose(11, 70), prose(12, 70) + " short item here",
    ]
    langs, sources = ["en", "de", None], ["s1", "s2", "s3", None, "n", ""]
    rows = [dict(doc_id=i, text=t, lang=langs[i % 3], source=sources[i % 6], n_chars=None if i % 4 == 0 else 5) for i, t in enumerate(texts)]
    rows += [dict(rows[10]), dict(rows[10]), dict(rows[0]), {**rows[14], "doc_id": 5}, {**rows[14], "doc_id": None}, dict.fromkeys(DOC)]
    return rows


def tables():
    docs = documents()
    return {
        "documents": docs,
        "labels": [dict(doc_id=i % 33, quality=int(i % 3 > 0) if i % 5 else None, toxic=None) for i in range(40)] + [dict(doc_id=None, quality=1, toxic=0)],
        "pages": [
            dict(page_id=1, url="http://a/", html=None), dict(page_id=2, url=None, html=""), dict(page_id=None, url="u", html="text only"),
            dict(page_id=3, url="u", html="<nav><a>menu</a></nav><article><h1>T &amp; t</h1><p>Some  long\n paragraph of the text here<p>No.</article><footer>f</footer>"),
            dict(page_id=3, url="u", html="<div><p>" + "very long text " * 30_000 + "</p></div>"), dict(page_id=4, url="u", html="<![x <p <b>a</b> <!-- <p>"),
        ],
        "conversations": [
            dict(conv_id=1, turn=1, role="assistant", text="b & <|end|> [INST] &lt; |"), dict(conv_id=1, turn=0, role="user", text="a"),
            dict(conv_id=1, turn=2, role=None, text=None), dict(conv_id=2, turn=0, role="assistant", text=None),
            dict(conv_id=2, turn=0, role="assistant", text="x"), dict(conv_id=2, turn=0, role="assistant", text="x"),
            dict(conv_id=None, turn=None, role="user", text="q"), dict(conv_id=None, turn=3, role="assistant", text="日本" * 20_000),
            *(dict(conv_id=3, turn=i, role=("user", "assistant")[i % 2], text=f"t{i}") for i in range(1100)),
            dict(conv_id=4, turn=5, role="a|>\n<|role:assistant", text="<|role:assistant|>\nx<|end|>\n"),
        ],
        "benchmark": [
            dict(item_id=10, text=prose("item", 30)), dict(item_id=9, text="Short, ITEM here!"), dict(item_id=2, text=prose("item", 30).upper()),
            dict(item_id=None, text=prose(11, 70)), dict(item_id=4, text=None), dict(item_id=5, text=""), dict(item_id=6, text="1234 5678"),
        ],
    }


def write(folder, data, extra=False):
    for name, fields in TABLES.items():
        rows, schema = data.get(name, []), pa.schema(list(fields.items()))
        t = pa.Table.from_pylist(rows, schema)
        if extra:
            for c in CLASH:
                if c not in fields:
                    t = t.append_column(c, pa.array([f"{c}{i % 2}" for i in range(len(rows))], pa.string()))
        pq.write_table(t, f"{folder}/{name}.parquet")
    return str(folder)
