"""Labelled pages for the extractor's weights: invented pages of common layouts, content between the marks [[ and ]]."""

_HEAD = '<!DOCTYPE html><html><head><meta charset="utf-8"><title>Some title here</title><link rel="x" href="y"></head><body>'

PAGES = [
    _HEAD + '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div>Sponsored words by a shop</div><article>[[<h1>A town and its river</h1><p>The river rose in March, and <b>many</b> houses were wet.<br>Boats came.</p><p>By <a href="/m">May</a> all was dry.</p><ul><li>First point of it</li><li>Second point</li></ul>]]</article><footer>&copy; 2020 Paper <a href="/t">Terms</a></footer></body></html>',
    _HEAD + '<header><a href="/">Site name</a><form><input name="q"><button>Search</button></form></header><main><section>[[<h1>On bread</h1><p>Bread needs flour, water, salt and time.</p><h2>Flour</h2><p>Rye is dark; wheat is light.</p><blockquote>Good bread takes a day.</blockquote><p>Bake it hot.</p>]]</section></main><aside><h3>More</h3><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></aside><footer><p>Contact us</p></footer></body></html>',
    _HEAD + '<table><tr><td><a href="/x">Start</a></td><td><a href="/y">Archive</a></td></tr></table><div><div>[[<h2>Birds of the marsh</h2><p>Herons stand still for hours.</p><p>Ducks do not.</p><pre>count 3 4 5</pre><p>Both leave in autumn, when the marsh is <i>cold</i>.</p>]]</div></div><div><ul><li><a href="/q">Next page</a></li><li><a href="/r">Share</a></li><li><a href="/s">Print</a></li></ul></div><div><span>All rights reserved</span></div></body></html>',
    _HEAD + '<div><a href="/in">Log in</a> <a href="/up">Sign up</a></div><article>[[<h1>How the bridge was built</h1><p>It took nine years and a war.</p><figure><figcaption>The bridge in snow</figcaption></figure><p>Stone came by <em>rail</em>.</p><ol><li>Piers</li><li>Arches</li></ol><p>It opened in June.</p>]]</article><section><h3>Replies</h3><div><span>ann</span> <span>Nice story</span></div></section><footer><ul><li><a href="/imprint">Imprint</a></li></ul></footer></body></html>',
    _HEAD + '<div id="top"><a href="/">Paper</a></div><div><div>[[<div><h1>A walk uphill</h1></div><div><p>The path is steep at first.</p></div><div><p>Then come woods, and <span>wide</span> views.</p></div><section><h3>The way down</h3><div>Follow the brook to the mill.</div><table><tr><td>Height</td><td>900 m</td></tr></table></section>]]</div></div><div><a href="/n">Newer</a> <a href="/o">Older</a></div></body></html>',
]
