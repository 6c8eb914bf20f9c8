from factloom.llm import license_scan


def test_wrapped_notices_are_found_and_blank_lines_part_them(spark):
    mit = ["# Permission is hereby granted, free of charge, to any person obtaining a copy", "# of this software and associated documentation files (the \"Software\"), to deal", "# in the Software without restriction"]
    texts = [
        "\n".join(mit),
        "\n\n".join(mit),
        "Copyright me. All rights reserved.\n" + "\n".join(mit),
        "x\n\nLicensed under the\nApache License,\nVersion 2.0.\n\ny",
        "Released under the MIT License.\nwords\nLicensed under the Apache License, Version 2.0.",
        "nothing of the\nkind",
        None,
    ]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string")
    rows = license_scan.licensed(docs, license_scan.fit()).collect()
    assert {r.doc_id: (r.licenses, r.n_license_lines) for r in rows} == {
        0: (["MIT"], 1),
        1: ([], 0),
        2: (["MIT", "Proprietary"], 2),
        3: (["Apache-2.0"], 1),
        4: (["Apache-2.0", "MIT"], 2),
        5: ([], 0),
        6: ([], 0),
        None: (["MIT"], 1),
    }


def test_rows_of_one_key_have_findings_of_their_own(spark):
    rows = [(3, "Licensed under the Apache License, Version 2.0."), (3, "nothing here at all"), (3, "Licensed under the Apache License, Version 2.0."), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS licenses", "1 AS line", "2 AS gram")
    got = sorted((r.doc_id or -1, r.text or "", r.licenses, r.n_license_lines) for r in license_scan.licensed(docs, license_scan.fit()).collect())
    assert got == [(-1, "", [], 0), (3, rows[0][1], ["Apache-2.0"], 1), (3, rows[0][1], ["Apache-2.0"], 1), (3, rows[1][1], [], 0), (4, "", [], 0)]
    assert license_scan.licensed(docs.limit(0), license_scan.fit()).collect() == []
