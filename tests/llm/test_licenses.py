import math

from seqweft.llm import licenses
from seqweft.llm.licenses import TEMPLATES, bigrams


def dice(a, b):
    x, y = bigrams(a), bigrams(b)
    return 2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values()))


def test_keys_are_exact():
    """A passage without any key of a template can't reach the threshold with it."""
    for p in licenses.profiles(TEMPLATES, 0.8):
        missing = sum(n for g, n in p["grams"].items() if g not in p["keys"])
        assert missing < p["size"] * 0.8 / 1.2 and p["keys"]


def test_passages(spark):
    mit, gpl = TEMPLATES["MIT-text"], TEMPLATES["GPL-3.0"]
    rows = [
        (1, mit),
        (2, f"Some text here.\n{gpl}\nMore of it."),
        (3, "intro\n\n" + "\n".join(" ".join(mit.split()[i : i + 9]) for i in range(0, len(mit.split()), 9)) + "\n\nrest of the text"),
        (4, gpl.replace("work", "thing") + "\r\nReleased under the MIT License."),
        (5, "Nothing of the kind, under the license of the poet."),
        (6, "\n".join(" ".join(mit.split()[i : i + 9]) for i in range(0, len(mit.split()), 9))),
        (7, "Licensed under CC BY-NC 4.0"),
        (8, "licensed under CC BY-NC 3.1 or so and more"),
    ]
    got = {r.doc_id: (r.licenses, r.n_passages) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT-text", 1), 2: ("GPL-3.0", 1), 3: ("MIT-text", 2), 4: ("GPL-3.0,MIT", 2), 5: ("", 0), 6: ("MIT-text", 1), 7: ("CC-BY-NC-4.0", 1), 8: ("", 0)}


def test_coefficient(spark):
    text = "This work is licensed under the GNU General Public License version 3 or later"
    got = licenses.matches(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    best = max((dice(text, t), n) for n, t in TEMPLATES.items())
    assert got.license == best[1] and math.isclose(got.dice, best[0])


def test_edges(spark, docs, odd_docs, no_docs):
    for d in (docs, odd_docs):
        got = licenses.scan(d).collect()
        assert len(got) == 11 and all((r.licenses, r.n_passages, r.best_dice) == ("", 0, None) for r in got)
    assert licenses.scan(no_docs).count() == 0
