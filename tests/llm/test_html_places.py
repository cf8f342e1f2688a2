"""Places of nodes among their siblings."""

import numpy as np
from pagewright.llm import html_extract


def test_places_among_many_siblings():
    page = "".join(f"<p>line {i}</p>" for i in range(1000))
    order, x = html_extract.featured(html_extract.parse(page))
    rows = [i for i, n in enumerate(order) if n.tag == "p"]
    assert len(rows) == 1000 and np.allclose(x[rows, -3], np.arange(1000) / 1000)
