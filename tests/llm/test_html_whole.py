"""All names of a tag and all open tags are seen, however many there are."""

import time

import numpy as np

from trellis.llm import html_text


def test_all_names():
    (leaf,) = html_text.leaves('<div class="mt-4 px-2 flex items-center justify-between comments">x</div>')
    assert "div.comments" in leaf.path and ".comments" in leaf.path
    few, many = html_text.inputs([html_text.leaves('<div class="a b c d e f">x</div>'), html_text.leaves('<div class="a b c d e f comments">x</div>')])
    assert (few != many).any()


def test_deep_pages():
    page = "<div>" * 300 + "<nav>a</nav><section class=comments>b</section><p>c</p>d" + "</div>" * 300 + "<footer>e</footer>"
    found = html_text.leaves(page)
    assert [x.text for x in found] == ["a", "b", "c", "d", "e"]
    assert [x.path[-1] for x in found] == ["nav", ".comments", "p", "div", "footer"]
    assert [len(x.path) for x in found] == [301, 303, 301, 300, 1]


def test_deep_pages_are_linear():
    def seconds(n):
        page = "<div>x" * n + "</b></div>" * n
        best = []
        for _ in range(3):
            began = time.perf_counter()
            found = html_text.leaves(page)
            assert len(found) == n and np.isfinite(html_text.inputs([found])).all()
            best.append(time.perf_counter() - began)
        return min(best)

    assert seconds(16_000) < 12 * seconds(4_000)
