"""License sentences as files hold them: short lines and wrapped sentences."""

from meridio.llm import licences

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
APACHE = """   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at"""


def test_wrapped_and_short_license_lines(spark):
    texts = [f"A\nB\n{MIT}", GPL, f"x\n{BSD}", APACHE, "prose\nAll rights reserved.\nmore", "Released under the MIT License", None]
    rows = [*enumerate(texts), (3, "other"), (None, BSD)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.license, r.block) for r in licences.scan_licenses(docs).collect()), key=str)
    want = [(0, "MIT", 0), (1, "GPL-3.0", 0), (2, "BSD", 1), (3, "Apache-2.0", 0), (4, "all-rights-reserved", 1), (5, "MIT", 0), (None, "BSD", 0)]
    assert got == sorted(want, key=str)


def test_full_notices(spark):
    docs = spark.createDataFrame([(k, "x " * k + text) for k, (_, text) in enumerate(licences.TEMPLATES)], "doc_id bigint, text string")
    got = {(r.doc_id, r.template, r.block, r.containment) for r in licences.scan_licenses(docs).collect()}
    assert all((k, k, k, 1.0) in got for k in range(len(licences.TEMPLATES)))
