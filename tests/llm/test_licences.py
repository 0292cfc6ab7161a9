"""Licence texts in runs of lines and whole."""

import textwrap

import pytest

from tidemark.llm import license_scan

FULL = 11  # licences() begins with the whole texts


def test_licences_in_runs_of_lines():
    m, prose = license_scan.Matcher(), "An ordinary line of words about nothing that any notice says."
    full = next(t for i, t in license_scan.TEMPLATES if i == "Apache-2.0" and len(t) > 400)
    three = full.replace(" You may obtain", "\n\nYou may obtain").replace(" Unless", "\n\nUnless").replace(" See the", "\nSee the")
    wrapped = "\n".join(textwrap.wrap(full, 60))
    for text in (f"{prose}\n\n{three}\n\n{prose}", f"{prose}\n{wrapped}\n{prose}"):
        assert max((x[1] for x in m.scan(text) if x[0] == "Apache-2.0"), default=0) > 0.99
    assert m.scan(f"{prose}\n{wrapped}\n{prose}")[-1][:4] == ("Apache-2.0", 1.0, "run", 1)
    plain = license_scan.Matcher(license_scan.TEMPLATES)  # runs without the full texts
    assert ("run", 2, 6) in [x[2:] for x in plain.scan(f"{prose}\n\n{three}\n\n{prose}") if x[0] == "Apache-2.0"]
    bsd = dict(license_scan.licences()[:FULL])["BSD-2-Clause"]
    assert ("BSD-2-Clause", 1.0) in [x[:2] for x in m.scan(f"Copyright 2020 Someone\n\n{bsd}")]
    assert m.scan("\n".join([prose] * 50)) == []


@pytest.mark.parametrize("name", ["GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Apache-2.0", "BSD-3-Clause", "MIT", "ISC", "Unlicense"])
def test_full_licences(name):
    text = dict(license_scan.licences()[:FULL])[name]
    got = license_scan.Matcher().scan(f"{text}\nand then code")
    assert (name, True) in [(x[0], x[1] > 0.99) for x in got]
