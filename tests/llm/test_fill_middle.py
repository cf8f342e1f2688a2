"""Fill-in-middle against a plain version, and exact restoration."""

import hashlib
import random
import re

from fixtures import documents, frame

from pagewright.llm import fill_middle


def plain(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(tokens)
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    if not text or re.search("<[PSM]>", text) or c % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(tokens[:lo]), "".join(tokens[lo:hi]), "".join(tokens[hi:])
    return n, *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if d % 100 < 80 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


def rows():
    r, out = random.Random(3), [list(x) for x in documents()]
    odd = ["<", "<<P", "P> <S", "a<P>b", "<M>", "\x00 a\x0bb", " lead", "trail \n", "<P <S <M", "a b " * 50_000, "東京 🙂 ß"]
    out += [[1000 + i, t, *out[0][2:]] for i, t in enumerate(odd * 20)]
    out += [[5000 + i, "".join(r.choices("<PSM> a\t", k=r.randint(0, 12))), *out[0][2:]] for i in range(400)]
    return [tuple(x) for x in out] + [(None, "no id here at all", *out[0][2:]), tuple(out[5]), tuple(out[5])]


def test_against_a_plain_version_and_back(spark):
    given = rows()
    docs = frame(spark, given)
    made = fill_middle.transformed(docs)
    got = sorted(((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in made.collect()), key=repr)
    assert got == sorted(((x[0], *plain(x[0], x[1])) for x in given), key=repr)
    assert {x[2] for x in got} == {"plain", "spm", "psm"}
    back = sorted(((x.doc_id, x.restored) for x in fill_middle.restored(made).collect()), key=repr)
    assert back == sorted(((x[0], x[1] or "") for x in given), key=repr)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = sorted(((x.doc_id, x.output_sha256, x.restored_sha256) for x in fill_middle.digests(docs).collect()), key=repr)
    assert digests == sorted(((x[0], sha(plain(x[0], x[1])[4]), sha(x[1] or "")) for x in given), key=repr)


def test_empty_table(spark):
    assert fill_middle.digests(frame(spark).limit(0)).count() == 0
