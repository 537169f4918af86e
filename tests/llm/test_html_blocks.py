"""Blocks of pages that the tree was not fitted on, drawn by a rule: with tags, with names, and plain ones."""

import random

from factloom.llm import html_text


def drawn_page(r, style):
    """(html, label) parts; label None: only a tag."""

    def words(lo, hi):
        return " ".join(f"w{r.randrange(99)}" for _ in range(r.randint(lo, hi)))

    def link(lo, hi):
        return f'<a href="/p">{words(lo, hi)}</a>'

    def article(plain):
        out = [(f"<h1>{words(3, 12)}</h1>", 1)]
        for _ in range(r.randint(2, 12)):
            k = r.random()
            if not plain and r.random() < 0.08:
                out.append((f"<p>{link(2, 6)}</p>", 1))
            else:
                out.append((f"<p>{words(15, 90) if k < 0.6 else words(2, 12) if k < 0.85 else f'{words(8, 40)} {link(1, 4)} {words(3, 20)}'}</p>", 1))
        if plain:  # without tags only numbers tell: it begins and ends with a long paragraph
            out = [out[0], (f"<p>{words(20, 90)}</p>", 1), *out[1:], (f"<p>{words(15, 60)}</p>", 1)]
        return out

    def links(tag, lo, hi):
        return [(f"<{tag}>{link(1, 3)}</{tag}>", 0) for _ in range(r.randint(lo, hi))]

    if style in ("article", "main"):
        body = article(False)
        if r.random() < 0.4:
            body.insert(r.randint(1, len(body)), (f'<div class="promo advert">{words(3, 30)}</div>', 0))
        comments = [('<section id="comments">', None), *[(f"<p>{words(2, 50)}</p>", 0) for _ in range(r.randint(1, 5))], ("</section>", None)]
        page = [("<header><nav><ul>", None), *links("li", 1, 7), ("</ul></nav></header>", None), (f'<div class="ad-slot">{words(4, 40)}</div>', 0)]
        page += [(f"<{style}>", None), *body, *(comments if r.random() < 0.4 else []), (f"</{style}>", None)]
        return [*page, (f"<aside><p>{words(5, 40)}</p></aside>", 0), (f"<footer>{words(3, 20)}</footer>", 0)]
    if style == "names":
        page = [('<div id="top-nav">', None), *links("p", 1, 7), ("</div>", None), (f'<div class="cookie-notice">{words(10, 40)}</div>', 0), ('<div class="content">', None), *article(True), ("</div>", None)]
        return [*page, (f'<div class="sidebar"><p>{words(5, 40)}</p></div>', 0), (f'<div class="page-footer">{words(3, 20)}</div>', 0)]
    return [*links("div", 2, 7), *article(True), *links("div", 2, 5)]


def test_held_out_blocks():
    r = random.Random(20)
    hit = wrong = lost = 0
    for i in range(400):
        parts = drawn_page(r, ("article", "main", "names", "plain")[i % 4])
        labels = [label for _, label in parts if label is not None]
        found = html_text.blocks("".join(s for s, _ in parts))
        assert len(found) == len(labels)
        for (_, features), label in zip(found, labels, strict=True):
            got = html_text.is_main(html_text.tree(), features)
            hit += got and label == 1
            wrong += got and label == 0
            lost += not got and label == 1
    assert hit / (hit + wrong) >= 0.98 and hit / (hit + lost) >= 0.98, (hit, wrong, lost)


def test_numbers_come_first_and_neighbours_take_part():
    tree, used = html_text.tree(), set()

    def walk(node):
        if not isinstance(node, int):
            used.add(html_text.FEATURES[node[0]])
            walk(node[2])
            walk(node[3])

    walk(tree)
    assert html_text.FEATURES[tree[0]] == "link_density"
    assert {"words", "prev_words", "prev_link_density", "next_link_density"} <= used


def test_articles_lose_nothing_for_its_name_or_size():
    assert html_text.main_text("<article><p>See <a>long link text only here</a></p><p>ok</p></article>") == "See long link text only here\n\nok"
    assert html_text.main_text(f'<div class="post-legal"><p>{"w " * 40}</p></div>') == ("w " * 40).strip()
    assert html_text.main_text("<article><p>a b</p><div class=legal><p>c d</p></div><div class=related><p>e f</p></div><p>end</p></article>") == "a b\n\nc d\n\nend"
