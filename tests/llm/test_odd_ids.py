"""The Jaccard join of ids with several texts and of rows without an id."""

from stallwise.llm import jaccard_join


def test_every_text_of_an_id_links(spark):
    """An id with two long texts is in the component of both; a row without an id links two others."""
    words = lambda name, n=60: [f"{name}{i}" for i in range(n)]
    text = lambda w: " ".join(w)
    a, b, c, d = words("a"), words("b", 90), words("c"), words("d")
    bridge, far = c[3:], c[3:-5] + ["z1", "z2"]
    rows = [
        (5, text(a)), (5, text(b)), (9, text([*a, "x"])), (7, text(["y", *b])), (7, text(["y", *b])),
        (20, text(c)), (None, text(bridge)), (21, text(far)), (None, text(d)), (None, ""), (5, None), (30, text(words("e"))),
    ]
    got = sorted(map(tuple, jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    want = [(5, 56, 5), (5, 86, 5), (9, 57, 5), (7, 87, 5), (7, 87, 5), (20, 56, 20), (None, 53, 20), (21, 50, 20), (None, 56, None), (None, 0, None), (5, 0, 5), (30, 56, 30)]
    assert got == sorted(want, key=repr)
