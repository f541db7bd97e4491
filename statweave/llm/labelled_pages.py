"""Labelled pages for the extractor: layouts written by hand, main elements marked ``data-main``."""

from __future__ import annotations

_TEXT = (
    "The harbour was quiet when the first boats came in, and nobody on the quay expected news before noon.",
    "Several families had waited since dawn; they spoke little, drank tea, and watched the grey line of the sea.",
    "By the evening the wind had turned, so the crews agreed to sail again as soon as the tide allowed it.",
    "What the report does not mention is the price of repairs, which has doubled within only two years.",
    "She closed the book, looked out of the window and said that the answer had been there all along.",
)
_ITEMS = "".join(f'<li><a href="/{x.lower()}">{x}</a></li>' for x in ("Home", "World", "Culture", "Sport", "Contact"))
_BODY = "".join(f"<p data-main>{x}</p>" for x in _TEXT)

LAYOUTS = (
    f'<body><nav><ul>{_ITEMS}</ul></nav><div class="content"><h1 data-main>News from the harbour</h1>{_BODY}</div>'
    '<footer>&copy; 2020 The Daily. All rights reserved.</footer></body>',
    f'<body><header><div class="logo">The Daily</div><ul>{_ITEMS}</ul></header><main><h1 data-main>A quiet day</h1>{_BODY}'
    '<section class="comments"><h3>3 comments</h3><p>Great read, thank you!</p><p>I do not agree with this at all.</p>'
    '</section></main><aside><h3>Most read</h3><ul><li><a href="/1">Ten tips</a></li><li><a href="/2">Old maps</a></li></ul>'
    '</aside></body>',
    f'<body><div id="cookie-notice">We use cookies to improve this site. <a href="/c">Accept</a></div><div id="menu">{_ITEMS}'
    f'</div><div class="post-body">{_BODY}<blockquote data-main>{_TEXT[2]}</blockquote></div>'
    '<div class="ad">Buy two, get one free. Order today!</div><div id="footer">Imprint | Privacy</div></body>',
    f'<body><table><tr><td class="sidebar"><ul>{_ITEMS}</ul></td><td><h2 data-main>On the price of repairs</h2>{_BODY}</td>'
    '</tr></table><form><label>Search</label><input name="q"></form><div class="footer">Contact us at the office.</div></body>',
    f'<body><article><header><h1 data-main>What was there all along</h1><p class="byline">By Ann Lee</p></header>{_BODY}'
    f'<ul><li data-main>{_TEXT[3]}</li><li data-main>{_TEXT[4]}</li></ul><div class="share">Share this article</div>'
    '<div class="related"><a href="/r">Related: the old port</a></div></article><footer>Terms of use</footer></body>',
    '<body><div class="newsletter"><p>Sign up for our weekly letter.</p><form><input><p>Your mail address</p></form></div>'
    f'<div class="entry">{_BODY}<pre data-main>cast off, then set sail</pre></div><div class="sponsored"><p>{_TEXT[1]}</p></div>'
    '<nav class="breadcrumb"><a href="/">Home</a> / <a href="/n">News</a></nav></body>',
)
