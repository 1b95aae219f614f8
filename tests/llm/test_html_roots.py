"""Content roots: read from the elements of the page, whatever comments, scripts, quoting and teaser cards say."""

import pytest

from palisade.llm.html_extract import default_weights, extract

STORY = "<p>The ferry came back to the island on Friday after a long winter of repairs in the yard.</p><p>Islanders met it at the pier with a band and with cake for the whole crew.</p>"
TEXT = "The ferry came back to the island on Friday after a long winter of repairs in the yard.\nIslanders met it at the pier with a band and with cake for the whole crew."
CARDS = "".join(f'<article><h3><a href="/{i}">Another story of the day {i}</a></h3></article>' for i in range(4))


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav><a href='/'>Home</a></nav><div role='main'>{STORY}</div></body>",
        f"<body><nav><a href='/'>Home</a></nav><div role=main>{STORY}</div></body>",
        f'<body><nav><a href="/">Home</a></nav><div class=x ROLE = "Main">{STORY}</div></body>',
        f"<body><script>var t = '<article>';</script><div>{STORY}</div></body>",
        f"<body><!-- <main> here --><div>{STORY}</div></body>",
        f'<body><div title="set role=main here">{STORY}</div></body>',
        f'<body><div data-role="main"></div><div>{STORY}</div></body>',
        f"<body><div>{STORY}</div><aside><article><p>Read this one too</p></article></aside></body>",
        f"<body><main></main><div>{STORY}</div></body>",
        f"<body><div>{STORY}</div><div>{CARDS}</div></body>",
        f"<body><p>Loose words here</p><article>{STORY}</article><p>Loose words there</p></body>",
    ],
)
def test_story_is_found(page):
    assert extract(page, default_weights()) == TEXT
