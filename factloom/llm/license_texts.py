"""Entire published licence texts, with the titles, endings and wordings in which they occur."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from pathlib import Path

FOLDER = Path(__file__).with_name("licenses")
HOW_TO = "END OF TERMS AND CONDITIONS"
FSF_ADDRESSES = [
    ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA"),
    ("51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA", "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA"),
]
#: Fixed values: (SPDX id, usual titles, marker after which the text may end). Without its title a text counts too. A file that holds its title has none here.
PUBLISHED = [
    ("Apache-2.0", ["Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/"], HOW_TO),
    ("GPL-2.0-only", [], HOW_TO), ("GPL-3.0-only", [], HOW_TO), ("LGPL-2.0-only", [], HOW_TO), ("LGPL-2.1-only", [], HOW_TO), ("LGPL-3.0-only", [], None),
    ("MPL-1.1", [], None), ("MPL-2.0", [], None), ("GFDL-1.2-only", [], "How to use this License for your documents"), ("GFDL-1.3-only", [], "How to use this License for your documents"),
    ("Artistic-1.0-Perl", [], None), ("Unlicense", ["The Unlicense", "Unlicense"], None), ("0BSD", ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD\n============="], None),
    ("Zlib", ["zlib License", "The zlib License", "The zlib/libpng License", "zlib/libpng license"], None),
    ("BSL-1.0", ["Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"], None),
    ("CC0-1.0", ["Creative Commons Legal Code"], None), ("CC-BY-SA-4.0", ["Creative Commons"], None), ("Unicode-3.0", [], None),
    ("OFL-1.1", [
        "SIL OPEN FONT LICENSE\nVersion 1.1 - 26 February 2007",
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.\nThis license is copied below, and is also available with a FAQ at:\nhttp://scripts.sil.org/OFL\nSIL OPEN FONT LICENSE Version 1.1 - 26 February 2007",
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.\nThis license is copied below, and is also available with a FAQ at:\nhttps://openfontlicense.org\nSIL OPEN FONT LICENSE Version 1.1 - 26 February 2007",
    ], None),
    ("BSD-2-Clause", ["BSD 2-Clause License", "The 2-Clause BSD License", "The BSD 2-Clause License", "Simplified BSD License", "BSD License", "The BSD License"], None),
]
BSD3_TITLES = ["BSD 3-Clause License", "The 3-Clause BSD License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD License", "The BSD License"]
BSD3_CLAUSES = [f"Neither the name of {owner} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." for owner in ("the copyright holder", "the <organization>", "the organization", "[project]", "the University", "Google Inc.")]
MIT_TITLES = ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "(The MIT License)", "MIT", "# MIT License", "Expat License"]
ISC_TITLES = ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"]


def read(name: str) -> str:
    return (FOLDER / f"{name}.txt").read_text(encoding="utf-8")


def _endings(text: str, marker: str | None) -> list[str]:
    """The whole text; and the text up to its appendix, with and without the line that stands before it."""
    if not marker:
        return [text]
    at = text.index(marker)
    return [text, text[:at]] + ([text[: at + len(marker)]] if marker == HOW_TO else [])


def _bsd(two: str) -> Iterator[tuple[str, str]]:
    """The BSD texts, their conditions numbered or not, in the wordings of the last sentences."""
    third = [None, *BSD3_CLAUSES]
    for clause, numbered, owner in product(third, (True, False), ("HOLDER", "OWNER")):
        text = two.replace("COPYRIGHT HOLDER OR", f"COPYRIGHT {owner} OR")
        if clause:
            text = text.replace("THIS SOFTWARE IS PROVIDED BY", f"3. {clause}\n\nTHIS SOFTWARE IS PROVIDED BY", 1)
        if not numbered:
            text = text.replace("1. Redis", "* Redis").replace("2. Redis", "* Redis").replace("3. Neither", "* Neither")
        yield ("BSD-3-Clause" if clause else "BSD-2-Clause"), text


def entire_texts(mit: str, isc: str) -> list[tuple[str, str]]:
    """(SPDX id, text) of every known form; mit is the MIT text with its title line, isc the ISC text without."""
    bare = mit.split("\n", 1)[1]
    out = [("MIT", bare), *(("MIT", f"{t}\n{bare}") for t in MIT_TITLES), *(("ISC", f"{t}\n{isc}") for t in ISC_TITLES)]
    for name, titles, marker in PUBLISHED:
        text = read(name)
        if name == "BSD-2-Clause":
            for spdx, body in _bsd(text):
                out += [(spdx, body), *((spdx, f"{t}\n{body}") for t in (titles if spdx == name else BSD3_TITLES))]
            continue
        forms = [text]
        for old, new in FSF_ADDRESSES:
            if old in text:
                forms.append(text.replace(old, new))
        for form in forms:
            for body in _endings(form, marker):
                out += [(name, body), *((name, f"{t}\n{body}") for t in titles)]
    return out
