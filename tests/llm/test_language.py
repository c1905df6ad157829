"""Prose of LaTeX by block, and languages of made-up documents with wrong labels."""

import random

from lanthorn.llm import language, latex_prose

WORDS = {
    "en": "the of and to in that is was for with this which are from been have not they would their there".split(),
    "de": "der die das und nicht eine mit sich auf für ist werden auch aus nach wurde über einem bei noch".split(),
    "nl": "het een van en niet dat zijn voor met aan ook worden deze naar wordt heeft over uit hebben nog".split(),
}


def prose(lang, rnd, sentences=3):
    return " ".join(" ".join(rnd.choice(WORDS[lang]) for _ in range(10)).capitalize() + "." for _ in range(sentences))


def test_blocks_and_markup():
    text = (
        "\r\n \r\n\\documentclass{article}\r\n\\title{Titel {\\\"u}ber}\r\n\t\r\n\\begin{document}\nFirst \\'etude, na\\\"{\\i}ve fa\\c{c}ade Stra{\\ss}e \\~ao ru\\'{\\i}do 50\\% of it. % a comment\n"
        "\n\n\\iffalse hidden\n\nhidden too\n\\fi\n\n\\section{Head \\emph{ing}}\\label{x}\nBody $a \\le b$ text~\\cite[p.~3]{k} \\emph{(une phrase)} here.\n\n\\begin{equation*}\nx\n\n y\\end{equation*}\n\n"
        "\\begin{figure}\\caption{A caption stays.}\\end{figure}\n\n\\begin{thebibliography}{9}\\bibitem{a} Some title.\n\nMore\n\\end{thebibliography}\n\n\\end{document}\n\nafter"
    )
    got = latex_prose.blocks(text, latex_prose.Accents())
    assert got == ["", "First étude, naïve façade Straße ão ruído 50 of it.", "", "", "Body text here.", "", "", "A caption stays.", "", "", "", ""]
    assert latex_prose.blocks(None, {}) == latex_prose.blocks("", {}) == []
    assert latex_prose.blocks("plain", latex_prose.Accents()) == ["plain"]


def test_languages_of_documents(spark):
    rnd = random.Random(8)
    docs, want, passages = [], {}, set()
    for i in range(240):
        lang = ("en", "de", "nl")[i % 3]
        other = ("de", "nl", "en")[i % 3]
        parts = [prose(lang, rnd) for _ in range(4)]
        if i % 5 == 0:
            parts[1 + i % 2] = prose(other, rnd)
            passages.add((i, 2 + i % 2, other))
        label = {0: None, 1: other, 2: "??"}.get(i % 11, {"en": "en-GB", "de": " German", "nl": "dut"}[lang])
        docs.append((i, label, "\n\n".join(parts), 1))
        want[i] = lang
    docs += [(900, "en", None, 1), (901, "de", "", 1), (902, None, "\\documentclass{a}\n\n\\begin{document}\n\n\\input{x}\n\n\\end{document}", 1), (903, "xx", prose("de", rnd, 3000), 1)]
    want[903] = "de"
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string, label int")
    rows = language.languages(df, language.fit(df)).collect()
    assert {r.doc_id: r.main for r in rows if r.main} == want
    assert {(r.doc_id, p.block_no, p.lang) for r in rows for p in r.passages} == passages
    labels = {r.doc_id: r.label for r in rows}
    assert labels[3] == "en" and labels[0] is None and labels[903] is None
    assert language.fit(df.limit(0)) == {}
    assert all(r.main is None for r in language.languages(df, {}).collect())


def test_narrow_margins_are_rejected():
    rnd = random.Random(9)
    d = {k: prose(k, rnd, 200).lower().encode() for k in WORDS}
    judge = language.Judge(d)
    main, conf, found = language.judge_document("Zxqj wvkp qqzz jjxx.\n\n" + prose("de", rnd, 5), judge, latex_prose.Accents(), margin=0.1)
    assert main == "de" and [n for n, _, _ in found] == [2] and 0 < conf <= 1
