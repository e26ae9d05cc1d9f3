"""Tables with spans against a plain grid, and content that is hidden, shown again, closed or chosen."""

import random

import pytest

from talus.llm.html_text import visible_text


def drawn(rng):
    """A table of random spans as HTML, and its grid: {(row, column): text}, each cell at its top left corner."""
    taken, grid, html = set(), {}, []
    rows, n = rng.randint(1, 5), 0
    for r in range(rows):
        cells, c = [], 0
        for _ in range(rng.randint(1, 4)):
            while (r, c) in taken:
                c += 1
            wide, high = rng.choice([1, 1, 2]), rng.choice([1, 1, 1, 2, 3])
            while any((r, c + k) in taken for k in range(wide)):
                wide -= 1
            text = "".join(rng.choices("abcdefg", k=rng.randint(1, 6))) + str(n)
            n += 1
            grid[r, c] = text
            taken |= {(r + j, c + k) for j in range(high) for k in range(wide)}
            cells.append(f"<td rowspan={high} colspan={wide}>{text}" + rng.choice(["", "</td>"]))
            c += wide
        html.append("<tr>" + "".join(cells))
    return "<table>" + "".join(html) + "</table>", grid, rows


def test_cells_stand_in_their_columns():
    rng = random.Random(3)
    for _ in range(300):
        html, grid, rows = drawn(rng)
        widths = [max([len(t) for (_, k), t in grid.items() if k == c], default=0) for c in range(max(c for _, c in grid) + 1)]
        lines = ["  ".join(grid.get((r, c), "").ljust(w) for c, w in enumerate(widths)).rstrip() for r in range(rows)]
        # columns behind the last filled one have no width
        assert [x.rstrip() for x in visible_text(html).split("\n")] == lines[:]


@pytest.mark.parametrize(
    "html,text",
    [
        ('<div style="visibility:hidden">no <p style="visibility:visible">yes <b style="visibility:hidden">not</b></p></div>ok', "yes\n\nok"),
        ('<div style="display:none"><p style="visibility:visible">no</p></div>ok', "ok"),
        ('<div style="visibility:hidden" hidden><p style="visibility:visible">no</p></div>ok', "ok"),
        ("<details><summary>Sum</summary>Body</details>after", "Sum\nafter"),
        ("<details open><summary>Sum</summary>Body</details>", "Sum\nBody"),
        ("<details>Body only</details>x", "x"),
        ("a <select><option>b<option selected>c &amp; d</select> e", "a c & d e"),
        ("<select><optgroup label=g><option>first<option>second</optgroup></select>", "first"),
        ("<select multiple><option>a<option>b</select>", "a b"),
        ("<select></select>x", "x"),
        ('<input type=submit value="Go"> <input type=text value=no> <button>Press</button>', "Go Press"),
        ("<table><tr><td rowspan=0>a<td colspan=x>b</table>", "a  b"),
    ],
)
def test_what_is_shown(html, text):
    assert visible_text(html) == text
