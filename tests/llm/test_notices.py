"""Licence notices as they stand in source headers."""

import pytest

from inkwell.llm import licenses

GPL = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version."


@pytest.mark.parametrize("text,want", [
    ("Permission to use, copy, modify, and/or\ndistribute this", ["ISC"]),
    ("# Licensed under the\n# Apache License,\n# Version 2.0", ["Apache-2.0"]),
    ("// All  rights\r\n// reserved.", ["LicenseRef-Proprietary"]),
    ("/* Mozilla Public */\n/* License */", ["MPL-2.0"]),
    ("/*\n" + GPL, ["GPL-3.0-or-later"]),
    (GPL.replace(",", ";", 1).replace("either version 3", "version 2").replace(" * ", "# "), ["GPL-2.0-only"]),
    ("all wrongs\nreserved", None),
])
def test_wrapped_notices(text, want):
    got = licenses.scan(text)
    assert (got and got[2]) == want
