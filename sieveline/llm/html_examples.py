"""The small labelled table of the block classifier: example pages written for this purpose.

The first word of each block carries its label: `+` for main text, `-` for everything else.
"""

_SHORT = "Short line."
_LONG = "The river rose for three days and the people of the town moved their boats to the upper quay before the water reached the market."
_MID = "Nobody was hurt and the shops opened again on Monday."
_PLAIN = "Rain is expected again later this week across the valley."

PAGES = (
    # article with navigation, advert and footer
    f'<body><nav><ul><li><a href="/">-Home</a></li><li><a href="/n">-News</a></li><li><a href="/c">-Contact us</a></li></ul></nav>'
    f'<div class="ad">-Buy two boats and get the third one free today only.</div><article><h1>+River floods the quay</h1>'
    f"<p>+{_LONG}<p>+{_SHORT}<p>+{_MID}</article><footer>-Copyright example net and partners. {_PLAIN}</footer>",
    # one paragraph, one word each
    f'<body><nav><a href="/">-Start</a></nav><div class="banner">-{_PLAIN}</div><article><h1>+Is</h1><p>+Yes.</p><p>+No.</p><p>+Of it.</p>'
    f"</article><footer>-{_MID} All rights reserved.</footer>",
    # header with slogan, main, sidebar, comments
    f'<body><header><div>-The Daily Quay</div><p>-{_MID}</p><a href="/login">-Log in</a></header><main><h1>+Boats</h1><p>+{_LONG}</p>'
    f"<ul><li>+Rope</li><li>+Oars</li><li>+A lamp for the night</li></ul><p>+{_LONG}</p><h2>+After</h2><p>+{_MID}</p></main>"
    f'<aside><h3>-Most read</h3><p>-{_PLAIN}</p><a href="/x">-Old harbour closes</a></aside>'
    f'<section id="comments"><h3>-Comments</h3><div>-{_LONG}</div><div>-I agree with all of this.</div></section>'
    f'<form><label>-Your name</label><p>-{_MID}</p></form><footer><p>-{_LONG}</p></footer>',
    # notice and newsletter around the article; related links and comments inside it
    f'<body><div class="cookie-notice">-We use cookies to improve this site and to measure visits. {_MID} <a href="/ok">Accept</a></div>'
    f'<article><header><h1>+Title of the piece</h1></header><p>+{_LONG}</p><blockquote>+{_MID}</blockquote><div class="share"><a href="/f">-Share this</a></div>'
    f'<p>+{_MID}</p><div class="related"><h4>-Related</h4><p>-{_LONG}</p></div><p>+{_SHORT}</p>'
    f'<div class="comments"><p>-{_LONG}</p><p>-{_SHORT}</p></div></article><div id="newsletter">-{_PLAIN} Sign up.</div>',
    # no article element: content in plain blocks, menus as link lists
    f'<body><div><a href="/">-Home</a></div><div><a href="/a">-About the town</a></div><div><a href="/b">-Boats and other things</a></div>'
    f'<div><h1>+The flood of last spring</h1><p>+{_LONG}</p><p>+{_LONG} {_MID}</p><p>+{_LONG}</p></div>'
    f'<div><a href="/p">-Previous</a> <a href="/q">next</a></div><div><a href="/t">-Terms of use</a></div>',
    # table layout with a link column
    f'<body><table><tr><td><a href="/1">-One</a></td><td><a href="/2">-Two links here</a></td></tr><tr><td>+{_LONG} {_LONG}</td></tr>'
    f'<tr><td>+{_LONG} {_MID}</td></tr><tr><td><a href="/3">-Three more links</a></td></tr></table><div class="copyright">-{_MID}</div>',
    # tables, code, captions and quotes inside the article
    f"<body><nav><p>-{_PLAIN}</p></nav><article><h1>+Levels</h1><table><tr><th>+Day</th><th>+Level</th></tr><tr><td>+Monday</td><td>+3.2</td></tr></table>"
    f'<figure><figcaption>+The quay at noon</figcaption></figure><pre>+level = 3.2</pre><p>+See <a href="/m">the map of the river</a></p><p>+{_MID}</p>'
    f'<ul><li><a href="/s">+A source with a long name</a></li></ul></article><aside>-{_LONG}</aside><footer><a href="/i">-Imprint</a></footer>',
    # sidebar and popup as classes, main by role
    f'<body><div id="sidebar"><p>-{_LONG}</p><p>-{_SHORT}</p></div><div role="main"><p>+{_LONG}</p><p>+{_SHORT}</p><p>+{_PLAIN}</p></div>'
    f'<div class="popup"><p>-{_LONG}</p></div><div role="navigation"><a href="/z">-Up</a></div><div class="advert">-{_SHORT}</div>',
    # form, advert and notice without links between long paragraphs
    f'<body><article><p>+{_LONG}</p><div class="advertisement">-{_LONG}</div><p>+{_LONG}</p><form><p>-{_LONG}</p></form><p>+{_SHORT}</p>'
    f'<aside>-{_MID}</aside><p>+{_MID}</p><nav>-Contents</nav><p>+{_SHORT}</p></article><div class="notice">-{_LONG}</div><section class="comment-list"><p>-{_LONG}</p></section>',
    # header and footer alone around bare paragraphs
    f"<body><header>-{_LONG}</header><p>+{_LONG}</p><p>+{_LONG} {_LONG}</p><p>+{_MID} {_PLAIN}</p><footer>-{_LONG}</footer>",
)


def _text(words: int) -> str:
    return " ".join((_LONG.split() * 3)[:words])


def _varied(words: int, other: int) -> tuple[str, ...]:
    """Pages whose frames, notices and comments are `words` long and whose paragraphs are `other`."""
    a, b = _text(words), _text(other)
    return (
        f'<body><nav><p>-{a}</p></nav><div class="ad">-{a}</div><article><h1>+{b}</h1><p>+{b}</p><p>+{a}</p></article><footer>-{a}</footer>',
        f"<body><header>-{a}</header><article><p>+{b}</p><p>+{b}</p></article><aside><p>-{a}</p></aside><footer><p>-{b}</p><p>-{a}</p></footer>",
        f'<body><article><p>+{a}</p><p>+{b}</p></article><section class="comments"><p>-{a}</p><p>-{b}</p></section><form><p>-{a}</p></form>',
        f"<body><header><p>-{a}</p></header><p>+{_LONG}</p><p>+{_LONG}</p><footer>-{a}</footer>",
        f'<body><div id="sidebar">-{a}</div><p>+{_LONG}</p><p>+{_LONG} {b}</p><div class="cookie-banner">-{a}</div>',
        f'<body><main><p>+{b}</p><div class="advert">-{a}</div><p>+{a}</p><form>-{a}</form><p>+{b}</p><aside>-{b}</aside></main>',
    )


PAGES += tuple(page for words, other in ((1, 12), (3, 30), (7, 2), (12, 60), (25, 6), (60, 25)) for page in _varied(words, other))
