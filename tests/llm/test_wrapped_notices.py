"""License scans find notices that are wrapped over lines."""

import re
import textwrap

from shelfmark.llm import licenses


def test_wrapped_notices(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    mit = "// Permission is hereby granted, free of charge, to any person obtaining\n// a copy of this software"
    rows = [bsd, mit, "# " + "\n# ".join(textwrap.wrap(licenses.TEMPLATES[5][1], 30)), "some text\n\n" + "\r\n".join(licenses.TEMPLATES[8][1].split(" ")) + "\n",
            # words too far apart are no notice
            re.sub("\n", "\n" + "other words " * 30 + "\n", bsd), "\n", "nothing\nhere \n"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["labels"], r["score"]) for r in got} == {0: ("bsd", 1.0), 1: ("mit", 1.0), 2: ("gpl", 1.0), 3: ("cc-by", 1.0), 4: ("", 0.0), 5: ("", 0.0), 6: ("", 0.0)}


def test_common_words_of_a_long_line_are_no_notice(spark):
    words = sorted(set(licenses.TEMPLATES[3][1].split(" ")))
    filler = " ".join(f"x{k}" for k in range(50))
    long = f" {filler} ".join(words)
    start = filler + " " + filler + " " + licenses.TEMPLATES[3][1] + " " + filler
    got = licenses.scan(spark.createDataFrame([(0, long), (1, start), (2, long + " " + start)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["labels"], r["score"]) for r in got} == {0: ("", 0.0), 1: ("apache", 1.0), 2: ("apache", 1.0)}
