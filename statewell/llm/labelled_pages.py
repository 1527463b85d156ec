"""Labelled pages for the content model: own layouts in which ``m="1"`` or ``m="0"`` labels a node and all below it.

S, M and L stand for texts of a few words, a sentence or two, and a paragraph.
"""

from __future__ import annotations

# The labelled pages.
PAGES = (
    '<body><nav><ul><li><a>S</a></li><li><a>S</a></li><li><a>S</a></li></ul></nav><div class="ad">M</div><article m="1"><h1>S</h1><p>L</p><p>L</p><p>S</p></article><footer>S · M</footer></body>',
    '<body><header><a>S</a><nav><a>S</a><a>S</a></nav></header><main m="1"><h1>S</h1><p>L</p><h2>S</h2><p>M</p><p>L</p></main><aside><h3>S</h3><ul><li><a>M</a></li><li><a>M</a></li></ul></aside><footer><p>M</p></footer></body>',
    '<body><div id="header"><div class="logo">S</div><ul class="menu"><li><a>S</a></li><li><a>S</a></li></ul></div><div id="content" m="1"><h1>S</h1><p>M</p><p>L</p></div><div id="sidebar"><h4>S</h4><p>M</p></div><div id="footer">M</div></body>',
    '<body><div class="top-bar"><a>S</a><a>S</a></div><div class="post" m="1"><h2>S</h2><div class="entry-content"><p>L</p><p>M</p><blockquote>M</blockquote><p>L</p></div><div class="share-buttons" m="0"><a>S</a><a>S</a></div></div><div id="comments" class="comments"><h3>S</h3><div class="comment"><p>M</p></div><div class="comment"><p>L</p></div></div></body>',
    '<body><div class="cookie-notice">M<button>S</button></div><div class="wrapper"><div class="article-body" m="1"><h1>S</h1><p>L</p><ul><li>M</li><li>M</li></ul><p>L</p></div><div class="related"><h3>S</h3><a>M</a><a>M</a></div></div></body>',
    '<body><div class="page"><div class="advert">M</div><section class="story" m="1"><h1>S</h1><p>M</p><div class="advertisement" m="0">S M</div><p>L</p><p>L</p></section><section class="comments"><p>M</p><p>L</p></section></div></body>',
    '<body><nav class="breadcrumb"><a>S</a><a>S</a></nav><article m="1"><header><h1>S</h1></header><p>L</p><figure><img><figcaption>M</figcaption></figure><p>L</p><aside class="promo" m="0">M</aside><p>M</p></article><form><label>S</label><input><button>S</button></form></body>',
    '<body><div role="banner">S</div><div role="navigation"><a>S</a></div><div role="main" m="1"><h1>S</h1><div>L</div><div>M</div></div><div role="complementary">M</div><div role="contentinfo">S</div></body>',
    '<body><table><tr><td class="menu"><a>S</a><a>S</a><a>S</a></td><td class="content" m="1"><h1>S</h1><p>L</p><p>L</p></td><td class="sidebar">M</td></tr></table></body>',
    '<body><div class="newsletter signup"><p>M</p><form><input><button>S</button></form></div><main><article m="1"><h1>S</h1><p>L</p><table><tr><th>S</th><td>S</td></tr><tr><th>S</th><td>S</td></tr></table><p>M</p><pre>M</pre></article><div class="pagination"><a>S</a><a>S</a></div></main></body>',
    '<body><div class="banner sponsored">M</div><div id="main"><div class="text" m="1"><h1>S</h1><p>S</p><p>M</p><p>L</p></div><div class="widget"><h4>S</h4><p>M</p></div></div><div class="site-footer"><p>M</p><a>S</a></div></body>',
    '<body><header class="site-header"><h2>S</h2><p>M</p></header><div class="container"><div class="main-content" m="1"><h1>S</h1><p>M</p><h3>S</h3><p>L</p><p>S</p></div></div><div class="popup modal"><p>M</p></div><div class="consent">M</div></body>',
    '<body><section><article m="1"><h2>S</h2><p>L</p><p>M</p><section class="comments" id="comments" m="0"><h3>S</h3><article class="comment"><p>M</p></article><article class="comment"><p>L</p></article></section></article></section><footer><nav><a>S</a></nav><p>S</p></footer></body>',
    '<body><div class="notice">M</div><div class="alert warning">M</div><article class="post-content" m="1"><h1>S</h1><p>M</p><p>M</p><ol><li>M</li><li>S</li></ol></article><div class="author-bio">M</div><div class="tags"><a>S</a><a>S</a></div></body>',
    '<body><ul id="nav"><li><a>S</a></li><li><a>S</a></li></ul><div class="content" m="1"><h1>S</h1><p>L</p><div class="ad-slot" m="0"><p>M</p></div><p>L</p><p>M</p><form class="subscribe" m="0"><p>M</p><input></form></div></body>',
    '<body><div class="share social"><a>S</a><a>S</a></div><main m="1"><h1>S</h1><p>L<a>S</a>M</p><p>M<b>S</b>M<i>S</i></p><p><span>L</span></p><div class="promo" m="0"><a>M</a></div></main><div id="respond"><h3>S</h3><form><textarea></textarea><p>S</p></form></div><div id="disqus"><p>M</p></div></body>',
    '<body><aside class="sidebar"><section><h3>S</h3><p>M</p></section></aside><article m="1"><h1>S</h1><p>M</p></article><aside class="related"><p>M</p></aside><footer class="footer"><p>S</p><ul><li><a>S</a></li></ul></footer></body>',
    '<body><div><div m="1"><p>L</p><p>L</p><p>M</p></div><div><a>S</a><a>S</a><a>S</a></div></div></body>',
    '<body><div class="hero banner"><p>S</p></div><div itemprop="articleBody" m="1"><p>L</p><p>S</p><p>L</p></div><div class="reader comments"><ol><li>M</li><li>L</li></ol></div><div class="disclaimer legal">M</div><div class="search"><form>S</form></div></body>',
    '<body><nav><a>S</a><a>S</a><a>S</a><a>S</a></nav><article m="1"><h1>M</h1><p>S</p></article><section id="reviews" class="comment-list"><p>L</p><p>M</p></section><div class="ads">S</div><footer>M</footer></body>',
    '<body><div class="skip hidden">S</div><article m="1"><h1>S</h1><p><b>L<br><p>L</p><p><em>M</em></p><div class="toc" m="0"><ul><li><a>S</a></li><li><a>S</a></li></ul></div><h2>S</h2><dl><dt>S</dt><dd>M</dd></dl></article><div class="trending popular"><ul><li><a>M</a></li></ul></div></body>',
    '<body m="1"><h1>S</h1><p>L</p><p>L</p><p>M</p></body>',
    '<body m="1"><h1>S</h1><p>M</p><h2>S</h2><p>L</p><ul><li>M</li><li>M</li></ul><div class="cookie-bar" m="0">M</div></body>',
    '<body m="1"><div class="masthead header" m="0"><h1>S</h1><p>S</p></div><p>L</p><p>M</p><p>L</p><hr><p class="footer-note" m="0">S</p></body>',
    '<body><header class="masthead"><h1>S</h1></header><div class="body" m="1"><h1>S</h1><p>M</p></div><div class="aside secondary">M</div><div class="comments-area"><p>M</p><p>L</p><p>L</p></div></body>',
    '<body m="1"><h1>S</h1><p>L</p><p>M</p><p>L</p><p>S</p></body>',
    '<body m="1"><p>M</p><p>L</p></body>',
    '<body><nav><a>S</a><a>S</a></nav><div class="ad">M</div><article m="1"><h1>S</h1><p><b>S<br><p>S</p></article><footer>M</footer></body>',
    '<body><article m="1"><h1>S</h1><p>S</p></article><div class="ad">M</div><footer>M</footer></body>',
    '<body><main m="1"><h1>S</h1><p>S</p></main><div>M</div><footer>S</footer></body>',
    '<body m="1"><p>L</p><p>L</p><form m="0"><p>M</p><input></form><div id="comments" m="0"><p>L</p></div></body>',
    '<body><div class="cookie">L</div><div class="notice"><p>L</p></div><article m="1"><h1>S</h1><p>L</p></article><div id="comments"><p>L</p><p>L</p></div><aside><p>L</p></aside></body>',
)
TEXTS = {
    "S": "A few words",
    "M": "One sentence of a common length tells about something that happened, and it ends here.",
    "L": "A paragraph of the story goes on for a while. " * 5,
}
