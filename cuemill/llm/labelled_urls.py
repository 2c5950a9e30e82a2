"""The small labelled URL table that the filter learns from: whole URLs on made-up hosts, written for this purpose.

KEPT_BACK holds URLs whose telling words occur nowhere in LABELLED; nothing is fitted on them.
"""

LABELLED = {
    1: """
http://best-casino-bonus-777.example.com/win/now?ref=8812
https://casino24-online.site.net/free-spins/100
http://poker-4-cash.example.org/go.php?id=99123
http://www.bets365-live.site.com/odds/today-win
http://super-slots-jackpot.example.net/slots/777/
https://lucky-lottery-winner.site.org/claim-prize/now
http://online-bets-and-poker.example.com/en-us/register-free
http://adult-cams-xxx.example.net/live/girls18
https://xxx-hot-videos-4u.site.com/watch/free/18plus
http://escort-girls-24-7.example.org/city/hot/
http://sexy-singles-near-you.site.net/meet-now?uid=71823
http://porn-tube-hd.example.com/xxx/4412.html
https://adult-dating-free.site.org/signup-now/1
http://cheap-viagra-pills.example.com/buy-now/50mg
https://pills-online-no-rx.site.net/order/cheap/100
http://buy-cialis-cheap-24.example.org/discount?c=991
http://diet-pills-fast-weight-loss.site.com/buy/now
http://no-prescription-meds4u.example.net/cheap-pills/
https://payday-loan-fast-cash.example.com/apply-now/1000
http://instant-loans-no-credit-check.site.org/cash/today
http://quick-cash-loan-4u.example.net/get/5000-now
http://free-crack-keygen-download.example.com/serial/2291
https://warez-full-version-free.site.net/dl/crack/91
http://torrent-movies-hd-free.example.org/download/x264-1080
http://nulled-scripts-free-download.site.com/get/88123
http://win-free-iphone-now.example.com/prize/claim?x=1
https://you-won-1000-gift-card.site.org/winner/8831
http://make-money-fast-at-home.example.net/earn-5000/week
http://work-from-home-easy-cash.site.com/join-now/
http://earn-bitcoin-free-daily.example.org/btc/claim/0.1
http://double-your-crypto-now.site.net/invest/200percent
http://cheap-replica-watches-4-sale.example.com/rolex-sale/
https://fake-designer-bags-outlet.site.org/sale/90-off
http://spam-farm-links-0012.example.net/l/0012/9931
http://link-farm-seo-777.site.com/backlinks/buy-1000
http://seo-backlinks-cheap-500.example.org/buy/links
http://click-here-now-free.example.com/?aff=11223&sub=99
http://casino-royal.site.com/en/12
http://www.mycasino.example.net/de/731
http://m.casino-club.example.org/fr/45?page=2
http://www.jackpot-win.site.net/de/14
https://win-big-today.example.org/de/88
http://shop.freebets.example.com/de/5
https://m.adult-chat.site.org/de/218
http://spam-links.site.org/en/300
http://linkspam.example.net/de/18
https://www.spam-site.example.com/es/902
http://adultvideo.site.com/fr/2
https://www.adult-only.example.com/es/640
http://betting.site.net/en/9
https://sportbets.example.org/de/77
http://www.bets-live.example.net/fr/5
http://linkfarm.site.com/fr/5
http://content-farm.example.net/en/61
http://hot-deals-4u-xx.site.net/track.php?aff_id=8831&cid=1
http://free-ringtones-download-now.example.org/sms/1
http://miracle-cure-secret-trick.site.com/one-weird-trick
""",
    0: """
https://www.example.com/
https://library.example.org/catalogue/history
https://www.cityhall.example.org/council/minutes
http://museum.example.net/exhibitions/painting
https://blog.gardenpath.example.com/growing-tomatoes
https://news.example.com/world/elections
https://news.example.net/de/politik
http://www.schoolboard.example.org/parents/calendar
https://docs.example.com/guide/install.html
https://docs.example.org/reference/functions
http://wiki.example.net/page/medieval_castles
https://wiki.example.org/wiki/River
https://recipes.example.com/bread/sourdough
http://kitchen.example.net/soups/lentil
https://forum.cyclists.example.org/thread/brakes
https://forum.example.com/topic/printer-drivers
http://weather.example.net/forecast/coast
https://university.example.org/physics/lectures
https://www.physics.example.org/papers/optics.pdf
http://journal.example.com/articles/geology
https://journal.example.net/archive/spring
http://theatre.example.org/season/hamlet
https://orchestra.example.com/concerts
http://www.trainline.example.net/timetable/north
https://bus.example.org/routes/harbour
http://clinic.example.com/patients/appointments
https://hospital.example.net/visitors
http://www.law.example.org/statutes/property
https://parliament.example.com/debates/budget
http://archive.example.net/letters/soldiers
https://en.example.com/articles/birds
http://fr.example.org/articles/oiseaux
https://de.example.net/artikel/vogel
http://es.example.com/articulos/aves
https://www.bookshop.example.org/novels
http://chess.example.net/openings/sicilian
https://astronomy.example.com/planets/saturn
http://hiking.example.org/trails/ridge
https://photos.example.net/albums/mountains
http://software.example.com/projects/parser
https://code.example.org/tree/main/readme
http://m.example.com/story/farmers-market
http://library.site.org/en/728
https://www.newspaper.example.net/de/412?page=2
http://m.health.example.org/fr/96
http://blog.teachers.site.com/es/731
https://www.geography.example.com/en/18
http://music.site.net/de/55
https://farmers.example.org/en/9
http://adulteducation.example.net/de/640
http://better-reading.site.org/fr/300
http://www.casting.example.com/es/2
http://the-tower.site.net/en/902
https://m.other.example.org/de/77
http://then.site.com/fr/61
https://shop.example.net/tools/hammer
http://blog.example.org/notes/teaching
""",
}
KEPT_BACK = {
    1: """
http://roulette-tables-888-vip.site.net/play-4-real/9
http://blackjack-royale-99.example.org/vip/2000-free
https://bingo-hall-4u-777.site.com/go.php?id=5512
http://naughty-milfs-24.example.net/hd/18plus/7
https://steroids-muscle-fast.site.org/buy-cheap/20mg
http://anabolic-shop-no-rx.example.com/order-now/5
https://refinance-today-4-less.site.net/apply/now?c=1
http://keylogger-hack-tool.example.com/free-download/331
https://cheats-unlimited-coins.site.org/generator/9999
http://forex-signals-profit-99.example.net/earn/daily-1000
https://sweepstakes-entry-2x.site.com/claim/prize-now
http://get-followers-4-free.example.org/buy/5000-likes
""",
    0: """
https://www.aquarium.example.org/otters
http://botany.example.net/ferns/moss
https://poetry.example.com/sonnets
http://cathedral.example.org/choir/evensong
https://www.brewery.example.net/tours
http://linguistics.example.com/phonology/vowels
https://rowing.example.org/regatta/results
http://ceramics.example.net/glazes/celadon
https://www.observatory.example.com/comets
http://opera.example.org/libretto/carmen
https://meteorology.example.net/clouds
http://www.harbourmaster.example.com/tides
""",
}


def rows(table: dict[int, str]) -> list[tuple[str, int]]:
    return [(url, bad) for bad, text in sorted(table.items()) for url in text.split()]
