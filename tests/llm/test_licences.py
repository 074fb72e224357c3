"""Licence notices that share a file with other notices, or with rarer licence words."""

from terracause.llm import licences
from tests.llm.fixtures import frame

NOTICE = {label: text for label, text, _ in licences.TEMPLATES}
FILLER = " " + "lorem ipsum dolor sit amet " * 40


def scan(spark, *texts):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    return {r.doc_id: r for r in licences.scan(frame(spark, rows)).collect()}


def test_every_notice_of_a_file_is_found(spark):
    every = sorted(NOTICE)
    got = scan(
        spark,
        FILLER.join(NOTICE[x] for x in ("bsd", "isc")),
        FILLER.join(NOTICE[x] for x in ("isc", "mpl", "bsd")),
        FILLER.join(NOTICE[x] for x in ("cc-by-nc", "bsd")),
        FILLER.join(text for _, text, _ in licences.TEMPLATES),
        "the person granted a free copy of this form subject to terms " + FILLER + NOTICE["cc-by-nc"],
        *[FILLER] * 5,
        *[NOTICE["cc-by-nc"]] * 5,
    )
    assert [got[i].labels for i in range(5)] == ["bsd,isc", "bsd,isc,mpl", "bsd,cc-by-nc", ",".join(every), "cc-by-nc"]
    assert all(got[i].score == 1 for i in range(5))
    assert got[5].labels == ""
