"""Page layouts written and labelled by hand: (html, the main text).  None is made by the training generator."""

LAYOUTS = [
    ("<html><head><title>A</title><body class='single has-sidebar'><div id=top><a href=/>Home</a> <a href=/n>News</a></div><div class=entry><h1>Storm closes port</h1><p>Ships waited outside the harbour on Monday, the port office said.</p><p>Work should resume on Tuesday.</p></div><div id=sidebar><h3>Most read</h3><ul><li><a href=1>Budget passes</a><li><a href=2>Bridge reopens</a></ul></div>",
     "Storm closes port Ships waited outside the harbour on Monday, the port office said. Work should resume on Tuesday."),
    ("<article><header><h1>On bread</h1></header><p>Flour, water and salt are enough.</p><footer><p>Tags: <a href=a>food</a></p></footer></article><section class=comments><article class=comment><p>I tried it, lovely crust!</p></article></section>",
     "On bread Flour, water and salt are enough."),
    ("<body><table width=100%><tr><td colspan=2><a href=/>Index</a> | <a href=/b>Back</a></td></tr><tr><td class=nav><a href=1>One</a><br><a href=2>Two</a></td><td class=content><h2>Pump manual</h2>Open the valve before you start the pump.<br>Close it afterwards, and drain the hose.</td></tr></table>",
     "Pump manual Open the valve before you start the pump. Close it afterwards, and drain the hose."),
    ("<div class=cookie-banner><p>We use cookies to improve your visit.</p><button>Accept</button></div><main><h1>Trail report</h1><p>The upper path is dry, but the ford is deep after the rain.</p></main><footer>© Hill Club</footer>",
     "Trail report The upper path is dry, but the ford is deep after the rain."),
    ("<nav><ul><li><a href=/>Start</a></ul></nav><main><article><p>Let <math><mi>a</mi><mo>+</mo><mi>b</mi></math> be even.</p><p>Then both are odd, or both are even.</p></article></main>",
     "Let a+b be even. Then both are odd, or both are even."),
    ("<div class=site-header><span>The Daily Lamp</span></div><div class=post><h2 class=post-title>Quiet streets</h2><div class=post-body><p>Nobody came to the fair this year, said the baker.</p><div class=ad>Cheap lamps here</div><p>Next year will be better, she hopes.</p></div></div><div class=site-footer>All rights reserved</div>",
     "Quiet streets Nobody came to the fair this year, said the baker. Next year will be better, she hopes."),
    ("<header role=banner><a href=/>Museum</a></header><section role=main><h1>The blue vase</h1><p>Made in 1820, it was broken twice and mended with gold.</p></section><aside role=complementary><p>Plan your visit today.</p></aside>",
     "The blue vase Made in 1820, it was broken twice and mended with gold."),
    ("<article><h1>Soup</h1><p>Serves four.</p><ul><li>two onions<li>one leek<li>salt</ul><ol><li>Chop all of it.<li>Boil for an hour, then season.</ol></article><div class=related><h4>Related</h4><a href=x>Stew</a> <a href=y>Broth</a></div>",
     "Soup Serves four. two onions one leek salt Chop all of it. Boil for an hour, then season."),
    ("<div id=wrapper><div id=menu><ul><li><a href=1>Docs</a><li><a href=2>API</a></ul></div><div id=content><h1>Install</h1><p>Unpack the archive and run the script.</p><pre><code>make all</code></pre><p>That is all.</p></div><div id=footer>Powered by a small server</div></div>",
     "Install Unpack the archive and run the script. make all That is all."),
    ("<article><h1>Election night</h1><p>Votes were counted until four in the morning.</p><aside class=newsletter><form><p>Get our newsletter</p><input><button>Sign up</button></form></aside><p>The mayor lost by nine votes, the clerk said.</p></article>",
     "Election night Votes were counted until four in the morning. The mayor lost by nine votes, the clerk said."),
    ("<div class=topbar><a href=/>Forum</a><a href=/login>Log in</a></div><main><h1>How do bees find home</h1><p>They learn the landmarks near the hive, and the place of the sun.</p></main><div id=comments><h3>Comments</h3><div class=comment><p>Great read, thanks.</p></div><div class=comment><p>My bees never come back.</p></div></div>",
     "How do bees find home They learn the landmarks near the hive, and the place of the sun."),
    ("<noscript>Please enable JavaScript to use this site.</noscript><article><h1>Night train</h1><p>The sleeper to the coast runs again from May, with six cars.</p></article>",
     "Night train The sleeper to the coast runs again from May, with six cars."),
    ("<article><h1>Market</h1><p title=\"it>Prices rose, the report says, by a tenth.</p><p>Wheat fell.</p></article><footer>© Trade Desk</footer>",
     "Market Prices rose, the report says, by a tenth. Wheat fell."),
    ("<svg/><div class=page><article><h2>Icons</h2><p>Draw <svg viewBox='0 0 1 1'><path d=M0/></svg> them small, and test them at night.</p></article></div>",
     "Icons Draw them small, and test them at night."),
    ("<article><p>Unclosed paragraphs are common.<p>Readers must cope with <b>them<p>and go on, always.</article><nav><a href=1>Older</a><a href=2>Newer</a></nav>",
     "Unclosed paragraphs are common. Readers must cope with them and go on, always."),
    ("<div class='breadcrumbs'><a href=/>Home</a> &gt; <a href=/g>Garden</a></div><div class=article-content><h1>Pruning</h1><p>Cut above a bud, in late winter, with a clean blade.</p><blockquote>Never cut in frost.</blockquote></div><div class='share-buttons'><a href=t>Share</a><a href=m>Mail</a></div>",
     "Pruning Cut above a bud, in late winter, with a clean blade. Never cut in frost."),
    ("<main id=main><article class=hentry><h1 class=entry-title>Budget vote</h1><div class=entry-meta><a href=/au>Staff</a> <a href=/d>3 May</a></div><div class=entry-content><p>The council passed the budget, nine to six, after a long debate.</p></div></article></main><div class=widget-area><div class=widget><p>Follow us everywhere.</p></div></div>",
     "Budget vote The council passed the budget, nine to six, after a long debate."),
    ("<div class='modal popup'><p>Subscribe now for one coin a week.</p></div><div class=column><h1>Lost cat found</h1><p>After eleven days the cat walked in, thin and loud.</p></div>",
     "Lost cat found After eleven days the cat walked in, thin and loud."),
    ("<article><h1>Results</h1><table><tr><th>Team<th>Points<tr><td>North<td>12<tr><td>South<td>9</table><p>North lead the table with two games left.</p></article>",
     "Results Team Points North 12 South 9 North lead the table with two games left."),
    ("<div id=header><h1>Blog of a sailor</h1></div><div id=main><div class=post><p>We left at dawn, with a light wind from the west, and saw no ship all day.</p><p>Supper was beans.</p></div></div><div id=right class=sidebar><p>About me: I sail.</p></div>",
     "We left at dawn, with a light wind from the west, and saw no ship all day. Supper was beans."),
    ("<article lang=de><h1>Der Wald</h1><p>Im Herbst wird der Wald still, und die Wege sind leer.</p></article><footer><p>Impressum</p></footer>",
     "Der Wald Im Herbst wird der Wald still, und die Wege sind leer."),
    ("<main><h1>Words</h1><dl><dt>Keel<dd>The long beam under a ship, from bow to stern.<dt>Mast<dd>It holds the sails.</dl></main><div role=contentinfo>Glossary project</div>",
     "Words Keel The long beam under a ship, from bow to stern. Mast It holds the sails."),
    ("<article><h1>Film night</h1><object data=f.swf>The film shows a river, seen from a bridge.</object><p>Bring a chair, and a coat.</p></article>",
     "Film night The film shows a river, seen from a bridge. Bring a chair, and a coat."),
    ("<ul class=menu><li><a href=1>World</a><li><a href=2>Sport</a></ul><div class=content><p>By the time the rain stopped, half the field had left, and the judges with it.</p><p>The race was run again on Sunday.</p></div><div class=copyright>© 2020</div>",
     "By the time the rain stopped, half the field had left, and the judges with it. The race was run again on Sunday."),
    ("<article><section><h2>First part</h2><p>It begins with a letter that nobody opened.</p></section><section><h2>Second part</h2><p>It ends with a fire, as such tales do.</p></section></article><aside><h3>Also by this author</h3><ul><li><a href=b>The Well</a></ul></aside>",
     "First part It begins with a letter that nobody opened. Second part It ends with a fire, as such tales do."),
    ("<form class=search><label>Search</label><input><select><option>All<option>Books</select></form><article><h1>Stars</h1><p>Some are older than the rest, by far, and redder.</p></article>",
     "Stars Some are older than the rest, by far, and redder."),
    ("<div style='display:none'><p>Hidden words for machines only.</p></div><article><h1>Visible</h1><p>These words can be read, and should be kept.</p></article>",
     "Visible These words can be read, and should be kept."),
    ("<main><article><h1>Cheese</h1><figure><img src=c.jpg><figcaption>A wheel of hard cheese.</figcaption></figure><p>It ages for a year, in a cave, and is turned each week.</p></article><div class=sponsored><p>Buy our crackers.</p></div></main>",
     "Cheese A wheel of hard cheese. It ages for a year, in a cave, and is turned each week."),
    ("<article><h1>Notes</h1><p>One &amp; two &lt; three.</p><p>caf&eacute;&nbsp;open&#33;</p></article>",
     "Notes One & two < three. café open!"),
    ("<header class=masthead><div class=logo>Gazette</div></header><div itemprop=articleBody class=rich-text><p>Rain fell for nine days, and the river rose above the old stones.</p><p>On the tenth it stopped.</p></div><div class=author-bio><p>Ann writes about rivers.</p></div>",
     "Rain fell for nine days, and the river rose above the old stones. On the tenth it stopped."),
    ("<div class=alert role=alert>Your browser is old.</div><div id=page><div class=main-content><h1>Glass</h1><p>Sand, soda and lime melt at great heat, and cool to glass.</p></div></div>",
     "Glass Sand, soda and lime melt at great heat, and cool to glass."),
    ("<article><h1>Q and A</h1><p><b>Why?</b><br>Because it works, we think.</p><p><b>How?</b><br>Slowly.</p></article><ol class=commentlist><li><b>Bo</b><p>Not convinced at all.</p></ol>",
     "Q and A Why? Because it works, we think. How? Slowly."),
]
