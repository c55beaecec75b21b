"""Labelled sample pages for the content weights, written for this purpose.

Each page puts kinds of boilerplate around and inside an article. ``data-content`` marks the elements
whose text belongs to the article; what lies in a ``data-other`` element below them does not.
"""

from __future__ import annotations

#: Names that sites commonly give to elements, by what the elements hold.
OTHER_NAMES = (
    "ad ads advert advertisement adsense banner sponsor sponsored promo promotion sidebar side widget menu nav navigation "
    "navbar breadcrumb breadcrumbs cookie cookies consent gdpr notice notification alert popup modal overlay newsletter "
    "subscribe signup login comment comments reply replies respond disqus discussion share sharing social related "
    "recommended recommendations teaser footer header masthead topbar copyright legal disclaimer pagination pager search "
    "toolbar tags skip toc hidden paywall complementary contentinfo dialog"
).split()
CONTENT_NAMES = "content article post entry story body main text page container wrapper paragraph lead section".split()
OTHER_TAGS = "nav header footer aside form button select noscript iframe dialog menu title".split()


def sample_pages() -> list[str]:
    pages = []
    words = "one two three four five six seven eight nine ten"
    for name in OTHER_NAMES:
        for kind in ("class", "id", "role"):
            other = f'<div data-other="1" {kind}="{name}">{words}</div>'
            pages.append(f'<body>{other}<article data-content="1"><h1>{words}</h1><p>{words}</p><p>{words}</p></article>{other}</body>')
    for tag in OTHER_TAGS:
        other = f'<{tag} data-other="1">{words}</{tag}>'
        pages.append(f'<body>{other}<main data-content="1"><h2>{words}</h2><p>{words}</p>{other}<p>{words}</p></main>{other}</body>')
    for name in CONTENT_NAMES:
        for kind in ("class", "id", "role"):
            lists = "".join(f'<li data-other="1"><a href="/{w}">{w}</a></li>' for w in words.split())
            body = f"<p>{words} <a>{words}</a></p><ul><li>{words}</li></ul><blockquote>{words}</blockquote><pre>{words}</pre>"
            pages.append(f'<body><ul>{lists}</ul><div {kind}="{name}" data-content="1"><h3>{words}</h3>{body}</div></body>')
    pages.append(f'<body><article data-content="1"><header><h1>{words}</h1></header><p>{words}</p></article></body>' )
    return pages
