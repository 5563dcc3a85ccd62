"""Licence scans: what is looked at, wrapped notices, and a scan that judges every paragraph."""

import random
import textwrap

import pytest

from marlstone.llm import licenses

NAMED = {
    "Distributed under the LGPL v2.1.": "lgpl", "GNU AGPL v3": "unknown", "Apache-2.0": "apache-2.0", "unter der MIT-Lizenz": "mit", "BSD 3-Clause": "bsd", "MPL 2.0": "mpl-2.0", "ISC": "isc",
    "veröffentlicht unter der GPL": "gpl", "The apache tribe and the gnu in the park.": "none", "Students at mit work under a grant.": "none",
}


@pytest.fixture(scope="module")
def classifier():
    return licenses.Classifier()


def test_names(spark, classifier):
    for text, family in NAMED.items():
        assert [f for *_, f in licenses.scan(text, classifier)] == ([family] if family != "none" else []), text
    docs = spark.createDataFrame(list(enumerate(NAMED)), "doc_id long, text string")
    got = {r.doc_id: (r.n_found, r.n_unknown, r.licenses) for r in licenses.license_scan(docs).collect()}
    assert got == {i: (int(f != "none"), int(f == "unknown"), f if f not in ("none", "unknown") else "") for i, f in enumerate(NAMED.values())}


def test_no_family_is_passed_over(classifier):
    r, unsigned = random.Random(1), 0
    for notice in (n for notices in licenses.NOTICES.values() for n in notices):
        for _ in range(60):
            text = " ".join(w for w in notice.split() if r.random() > 0.12)
            name = classifier(text)[0] if text else "none"
            if name in licenses.NOTICES:
                unsigned += not licenses.re.search(licenses.SIGNS, text)
                assert [f for *_, f in licenses.scan(text, classifier)] == [name], text
    assert unsigned


def test_wrapped_notices_of_all_families(classifier):
    for family, notices in licenses.NOTICES.items():
        for notice in notices:
            for width, lead in ((30, "# "), (40, ""), (60, " * "), (75, "// ")):
                header = "\n".join(lead + line for line in textwrap.wrap(notice, width))
                text = f"int main;\n\n{header}\n\nint other;"
                assert {f for *_, f in licenses.scan(text, classifier)} == {family}, text
    both = "Licensed under CC BY 4.0.\nReleased under the MIT License.\nand more words"
    assert [f for *_, f in licenses.scan(both, classifier)] == ["cc-by", "mit"]


def test_scan_equals_judging_every_paragraph(classifier):
    r, words = random.Random(4), "tide lamp river public software stone under the of conditions license copy general granted a b".split()
    notices = [n for some in licenses.NOTICES.values() for n in some] + list(NAMED) + ["Licensed under the Zorble License."]
    for k in range(60):
        lines = []
        for _ in range(r.randint(1, 9)):
            line = " ".join(r.choice(words) for _ in range(r.choice((0, 3, 12, 90))))
            lines += textwrap.wrap(f"{line} {r.choice(notices)}", r.choice((40, 200, 10_000))) if r.random() < 0.4 else [line]
        text = "\n".join(lines)
        every = [(start, end, block, *licenses.judged(text[start:end], classifier)) for start, end, block in licenses.paragraphs(text)]
        assert licenses.scan(text, classifier) == licenses.settled(every), k
