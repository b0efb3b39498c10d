"""Notices that no template was made from, and texts that only look like notices."""

from fabriloom.llm import licenses

# Notices as files have them, with the labels that they should get.
NOTICES = [
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.", "cc-by-nc-sa"),
    ("This article is licensed under a Creative Commons Attribution-NoDerivatives 4.0 license", "cc-by-nd"),
    ("Photos are licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 2.0 Generic License", "cc-by-nc-nd"),
    ("This is an open access article distributed under the Creative Commons Attribution License, which permits use", "cc-by"),
    ("Licensed under CC BY 4.0", "cc-by"),
    ("Content is licensed under CC-BY-SA 4.0 unless noted.", "cc-by-sa"),
    ("Data licensed under CC BY-ND.", "cc-by-nd"),
    ("It is released under the MIT License (see LICENSE).", "mit"),
    ("SPDX-License-Identifier: MIT", "mit"),
    ("// SPDX-License-Identifier: Apache-2.0", "apache-2"),
    ("# SPDX-License-Identifier: GPL-2.0-only", "gpl-2"),
    ("# SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3"),
    ("/* SPDX-License-Identifier: BSD-3-Clause */", "bsd"),
    ("SPDX-License-Identifier: ISC", "isc"),
    ("SPDX-License-Identifier: LGPL-2.1+", "lgpl"),
    ("SPDX-License-Identifier: AGPL-3.0", "agpl"),
    ("SPDX-License-Identifier: MPL-2.0", "mpl-2"),
    ("SPDX-License-Identifier: EPL-2.0", "epl"),
    ("SPDX-License-Identifier: CC0-1.0", "cc0"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance", "apache-2"),
    ("The code is licensed under the Apache 2.0 license.", "apache-2"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published", "agpl"),
    ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lgpl"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl,gpl-2"),
    ("it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or", "gpl-3"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided", "isc"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"),
    ("made available under the terms of the Eclipse Public License 2.0", "epl"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("To the extent possible under law, the author has dedicated this to the public domain under CC0 1.0.", "cc0"),
    ("Licensed under GPLv3.", "gpl-3"),
    ("(c) 2019 Example Corp. All rights reserved.", "all-rights-reserved"),
]
# Texts without a licence.
PLAIN = [
    "The creative commons of the village was open to all.", "She works at MIT and lives by the river.", "A driving license is required by law.", "The Mozilla team and the Apache helicopter met in public.",
    "Permission is required to enter; charge your phone first.", "They spoke of the general public and of its rights.", "Use, copy and modify are three verbs.", "Version 2 of the eclipse software was released under pressure.",
]


def test_held_notices(spark):
    rows = [t for t, _ in NOTICES] + PLAIN + [f"Intro words. {t} More words follow here." for t, _ in NOTICES]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(docs, licenses.word_idf(docs, licenses.vocabulary())).collect()}
    wrong = [(t, got[i], want) for i, (t, want) in enumerate(NOTICES) if got[i] != want]
    assert wrong == []
    assert [got[len(NOTICES) + len(PLAIN) + i] for i in range(len(NOTICES))] == [want for _, want in NOTICES]
    assert [got[len(NOTICES) + i] for i in range(len(PLAIN))] == [""] * len(PLAIN)


def test_postings_are_intersected(spark):
    """Both rare words of a template, but not at the same relative position, make no candidate."""
    idf = dict.fromkeys(licenses.vocabulary(), 1.0)
    rare = licenses.index(idf)
    assert all(1 <= sum(t == u for where in rare.values() for u, _ in where) <= licenses.POSTINGS for t in range(len(licenses.TEMPLATES)))
    docs = spark.createDataFrame([(0, "rights all reserved all rights"), (1, "all rights reserved"), (2, "all all rights rights reserved")], "doc_id long, text string")
    assert [r["labels"] for r in licenses.scan(docs, idf).orderBy("doc_id").collect()] == ["", "all-rights-reserved", ""]
