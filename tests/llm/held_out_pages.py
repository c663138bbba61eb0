"""Pages of several layouts, written by hand, with the text an editor would call the article."""

PAGES = {
    "news": (
        """<!doctype html><html><head><title>Harbour reopens</title><script>var a="<p>no</p>"</script></head><body>
<header class="site-header"><a href="/">The Coast Daily</a><nav><ul><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav></header>
<main><article class="story"><h1>Harbour reopens after storm</h1>
<p>The harbour opened again on Monday, three weeks after the storm that broke its outer wall and sank four boats.</p>
<figure><img src=a.jpg><figcaption>The outer wall on Sunday.</figcaption></figure>
<p>Repairs will go on until spring, the harbour master said, and larger ships must wait outside for now.</p>
<div class="share"><ul><li><a href="/t">Tweet</a></li><li><a href="/f">Post</a></li></ul></div>
<h2>What comes next</h2><p>A new wall is planned, higher by two metres&nbsp;&mdash; if the money can be found.</p></article>
<aside class="related"><h3>More stories</h3><ul><li><a href="/1">Fish prices fall</a></li><li><a href="/2">Ferry strike ends</a></li></ul></aside></main>
<footer><p>&copy; The Coast Daily. All rights reserved.</p></footer></body></html>""",
        "Harbour reopens after storm The harbour opened again on Monday, three weeks after the storm that broke its outer wall and sank four boats. The outer wall on Sunday. Repairs will go on until spring, the harbour master said, and larger ships must wait outside for now. What comes next A new wall is planned, higher by two metres\xa0— if the money can be found.",
    ),
    "blog": (
        """<html><body><div id="header"><h1><a href="/">Slow Bread</a></h1></div><div id="wrap"><div class="post"><h2 class="entry-title">Rye on a weekday</h2>
<div class="entry-content"><p>Rye dough wants time, but not <em>your</em> time: mix it in the evening and leave it.</p><p>In the morning it has doubled.<br>Shape it wet.</p>
<blockquote><p>Patience is an ingredient.</p></blockquote><p>Bake it dark, for an hour at least, and wait a day before you cut it.</p></div></div>
<div id="comments"><h3>2 comments</h3><ol><li><p>Mine never rises at all, what do I do wrong with it?</p></li><li><p>Lovely loaf, thank you!</p></li></ol><form><textarea>Say <p> something</textarea><input type=submit></form></div></div>
<div id="sidebar"><h3>About</h3><p>I bake and write about it.</p><ul><li><a href="/a">Archive</a></li></ul></div><div id="footer">Powered by patience</div></body></html>""",
        "Rye on a weekday Rye dough wants time, but not your time: mix it in the evening and leave it. In the morning it has doubled. Shape it wet. Patience is an ingredient. Bake it dark, for an hour at least, and wait a day before you cut it.",
    ),
    "docs": (
        """<html><body><nav class="toc"><ul><li><a href="#a">Install</a></li><li><a href="#b">Use</a></li><li><a href="#c">Limits</a></li></ul></nav>
<main role="main"><h1>Reading tables</h1><p>A table is read with one call. The reader looks for a header and takes the first row that seems to be one.</p>
<pre>read("a.csv")
read("b.csv")</pre><h2>Limits</h2><table><tr><th>Rows</th><td>no limit</td></tr><tr><th>Columns</th><td>ten thousand</td></tr></table>
<p>Files are read as streams, so memory stays small.</p></main><footer><ul><li><a href="/l">Licence</a></li><li><a href="/c">Contact</a></li></ul></footer></body></html>""",
        'Reading tables A table is read with one call. The reader looks for a header and takes the first row that seems to be one. read("a.csv") read("b.csv") Limits Rows no limit Columns ten thousand Files are read as streams, so memory stays small.',
    ),
    "rules and slashes": (
        """<html><body><div class=menu><ul><li><a href=/>Home</a><li><a href=/b>Back</a></ul></div><article><h1>Two rivers</h1><script src=/a/b/>leak("this");</script>
<div>The first river rises in the hills and runs north for a hundred miles before it meets the sea.<hr>The second is shorter, but it carries more water than the first in every month of the year.</div>
<div class=note/>Both were surveyed again last summer.</div><p>Here is three.<table></table>bar is the local word for a sandbank.</article><div class="ad">Buy boots now, half price.</div></body></html>""",
        "Two rivers The first river rises in the hills and runs north for a hundred miles before it meets the sea. The second is shorter, but it carries more water than the first in every month of the year. Both were surveyed again last summer. Here is three. bar is the local word for a sandbank.",
    ),
    "recipe": (
        """<html><body><div class="cookie-notice"><p>We use cookies to make this site work for you.</p><button>Accept</button></div><header><div class="logo">Kitchen</div></header>
<article><header><h1>Lentil soup</h1></header><p>A soup for cold days, ready in half an hour.</p><h2>You need</h2><ul><li>two cups of lentils</li><li>one onion</li><li>salt</li></ul>
<section><h2>How to</h2><ol><li>Fry the onion until it is soft.</li><li>Add lentils and water and boil for twenty minutes.</li></ol></section>
<form class="newsletter"><label>Your mail</label><input><p>Get a recipe a week.</p><button>Join</button></form><p>It keeps for three days in the fridge.</p></article></body></html>""",
        "Lentil soup A soup for cold days, ready in half an hour. You need two cups of lentils one onion salt How to Fry the onion until it is soft. Add lentils and water and boil for twenty minutes. It keeps for three days in the fridge.",
    ),
    "bare": (
        """<html><body><ul><li><a href="/1">Index</a></li><li><a href="/2">Next</a></li></ul><p>There was once a miller who had three sons, and to the youngest he left nothing but a cat.</p>
<p>The cat asked for a pair of boots, and when it had them it went out into the world.</p><p>What it did there you know already, or you may read it on the next page.</p></body></html>""",
        "There was once a miller who had three sons, and to the youngest he left nothing but a cat. The cat asked for a pair of boots, and when it had them it went out into the world. What it did there you know already, or you may read it on the next page.",
    ),
    "wiki": (
        """<html><body><div id="navigation"><ul><li><a href="/m">Main page</a></li><li><a href="/r">Random article</a></li><li><a href="/h">Help</a></li></ul></div>
<div id="content"><h1>Lapwing</h1><div id="bodyContent"><p>The <b>lapwing</b> is a <a href="/bird">bird</a> of wet meadows, known for its crest and its tumbling flight.</p>
<h2>Range</h2><p>It breeds across the north of the continent and winters further south, often in large flocks.</p><h2>Food</h2><p>It eats worms and insects, mostly at night.</p></div></div>
<div id="footer"><p>This page was last edited on Tuesday.</p><ul><li><a href="/p">Privacy</a></li></ul></div></body></html>""",
        "Lapwing The lapwing is a bird of wet meadows, known for its crest and its tumbling flight. Range It breeds across the north of the continent and winters further south, often in large flocks. Food It eats worms and insects, mostly at night.",
    ),
    "sections": (
        """<html><body><header role="banner"><p>The Review</p><nav><a href="/i">Issue</a> <a href="/s">Subscribe</a></nav></header><div class="container"><div class="row"><div class="article-body">
<h1>On walking</h1><section><h2>One</h2><p>Nobody walks any more, they say, and yet the paths are full on every Sunday morning.</p></section><section><h2>Two</h2><p>I walked from the station to the lake in four hours and met eleven people.</p>
<div class="promo">Subscribe for the price of a coffee!</div><p>All of them said good day, and one of them told me about a shorter way.</p></section></div></div></div>
<section class="comments"><h3>Letters</h3><div class="comment"><p>I have walked it in three hours myself.</p></div></section></body></html>""",
        "On walking One Nobody walks any more, they say, and yet the paths are full on every Sunday morning. Two I walked from the station to the lake in four hours and met eleven people. All of them said good day, and one of them told me about a shorter way.",
    ),
    "unclosed": (
        """<title>x</title><nav><ul><li><a href=/>home<li><a href=/b>b</ul></nav><article><h1>Fog</h1><p>Fog lay on the fields until noon.<p>Then it rose all at once, and behind it stood the mountains.<ul><li>first the near ones<li>then the far ones</ul></article><footer>made by hand""",
        "Fog Fog lay on the fields until noon. Then it rose all at once, and behind it stood the mountains. first the near ones then the far ones",
    ),
}
