"""The default lists of the junk filter. Lists of one's own can be passed in their place (``tables.lines`` reads them)."""

# Servers of advertisements, counters and statistics
DOMAINS = """
1ad.prolinks.de
1st-fuss.com
247media.com
admaximize.com
adbureau.net
adsolution.de
adwisdom.com
advertising.com
atwola.com
aladin.de
annonce.insite.dk
a.tribalfusion.com
avenuea.com
bannercommunity.de
banerswap.com
bizad.nikkeibp.co.jp
bluestreak.com
bs.gsanet.com
cash-for-clicks.de
cashformel.com
cash4banner.de
cgi.tietovalta.fi
cgicounter.puretec.de
click-fr.com
click.egroups.com
commonwealth.riddler.com
comtrack.comclick.com
customad.cnn.com
cybereps.com:8000
cyberclick.net
dino.mainz.ibm.de
dinoadserver1.roka.net
disneystoreaffiliates.com
dn.adzerver.com
doubleclick.net
ds.austriaonline.at
einets.com
emap.admedia.net
eu-adcenter.net
eurosponser.de
fastcounter.linkexchange.com
findcommerce.com
flycast.com
focalink.com
fp.buy.com
globaltrack.com
globaltrak.net
gsanet.com
hitbox.com
hurra.de
hyperbanner.net
iadnet.com
image.click2net.com
image.linkexchange.com
imageserv.adtech.de
imagine-inc.com
img.getstats.com
img.web.de
imgis.com
james.adbutler.de
jmcms.cydoor.com
leader.linkexchange.com
linkexchange.com
link4ads.com
link4link.com
linktrader.com
media.fastclick.net
media.interadnet.com
media.priceline.com
mediaplex.com
members.sexroulette.com
newsads.cmpnet.com
ngadcenter.net
nol.at:81
nrsite.com
offers.egroups.com
omdispatch.co.uk
orientserve.com
pagecount.com
preferences.com
promotions.yahoo.com
pub.chez.com
pub.nomade.fr
qa.ecoupons.com
qkimg.net
resource-marketing.com
revenue.infi.net
sam.songline.com
sally.songline.com
sextracker.com
smartage.com
smartclicks.com
spinbox1.filez.com
spinbox.versiontracker.com
stat.onestat.com
stats.surfaid.ihost.com
stats.webtrendslive.com
swiftad.com
tm.intervu.net
tracker.tradedoubler.com
ultra.multimania.com
ultra1.socomm.net
uproar.com
usads.imdb.com
valueclick.com
valueclick.net
victory.cnn.com
videoserver.kpix.com
view.atdmt.com
webcounter.goweb.de
websitesponser.de
werbung.guj.de
wvolante.com
www.ad-up.com
www.adclub.net
www.americanpassage.com
www.bannerland.de
www.bannermania.nom.pl
www.bizlink.ru
www.cash4banner.com
www.clickagents.com
www.clickthrough.ca
www.commision-junction.com
www.eads.com
www.flashbanner.no
www.mediashower.com
www.popupad.net
www.smartadserver.com
www.smartclicks.com:81
www.spinbox.com
www.sponsorpool.net
www.ugo.net
www.valueclick.com
www.virtual-hideout.net
www.web-stat.com
www.webpeep.com
www.zserver.com
www3.exn.net:80
xb.xoom.com
yimg.com
""".split()

# Patterns of paths of advertisements
PATTERNS = r"""
/*.*/(.*[-_.])?ads?[0-9]?(/|[-_.].*|\.(gif|jpe?g))
/*.*/(.*[-_.])?count(er)?(\.cgi|\.dll|\.exe|[?/])
/*.*/(.*[-_.].*)?maino(kset|nta|s).*(/|\.(gif|html?|jpe?g|png))
/*.*/(ilm(oitus)?|kampanja)(hallinta|kuvat?)(/|\.(gif|html?|jpe?g|png))
/*.*/(ng)?adclient\.cgi
/*.*/(plain|live|rotate)[-_.]?ads?/
/*.*/(sponsor|banner)s?[0-9]?/
/*.*/*preferences.com*
/*.*/.*banner([-_]?[a-z0-9]+)?\.(gif|jpg)
/*.*/.*bannr\.gif
/*.*/.*counter\.pl
/*.*/.*pb_ihtml\.gif
/*.*/Advertenties/
/*.*/Image/BannerAdvertising/
/*.*/[?]adserv
/*.*/_?(plain|live)?ads?(-banners)?/
/*.*/abanners/
/*.*/ad(sdna_image|gifs?)/
/*.*/ad(server|stream|juggler)\.(cgi|pl|dll|exe)
/*.*/adbanner*
/*.*/adfinity
/*.*/adgraphic*
/*.*/adimg/
/*.*/adjuggler
/*.*/adlib/server\.cgi
/*.*/ads\\
/*.*/adserver
/*.*/adstream\.cgi
/*.*/adv((er)?ts?|ertis(ing|ements?))?/
/*.*/advanbar\.(gif|jpg)
/*.*/advanbtn\.(gif|jpg)
/*.*/advantage\.(gif|jpg)
/*.*/amazon([a-zA-Z0-9]+)\.(gif|jpg)
/*.*/ana2ad\.gif
/*.*/anzei(gen)?/?
/*.*/ban[-_]cgi/
/*.*/banner_?ads/
/*.*/banner_?anzeigen
/*.*/bannerimage/
/*.*/banners?/
/*.*/banners?\.cgi/
/*.*/bizgrphx/
/*.*/biznetsmall\.(gif|jpg)
/*.*/bnlogo.(gif|jpg)
/*.*/buynow([a-zA-Z0-9]+)\.(gif|jpg)
/*.*/cgi-bin/centralad/getimage
/*.*/drwebster.gif
/*.*/epipo\.(gif|jpg)
/*.*/gsa_bs/gsa_bs.cmdl
/*.*/images/addver\.gif
/*.*/images/advert\.gif
/*.*/images/marketing/.*\.(gif|jpe?g)
/*.*/images/na/us/brand/
/*.*/images/topics/topicgimp\.gif
/*.*/phpAds/phpads.php
/*.*/phpAds/viewbanner.php
/*.*/place-ads
/*.*/popupads/
/*.*/promobar.*
/*.*/publicite/
/*.*/randomads/.*\.(gif|jpe?g)
/*.*/reklaam/.*\.(gif|jpe?g)
/*.*/reklama/.*\.(gif|jpe?g)
/*.*/reklame/.*\.(gif|jpe?g)
/*.*/servfu.pl
/*.*/siteads/
/*.*/smallad2\.gif
/*.*/spin_html/
/*.*/sponsor.*\.gif
/*.*/sponsors?[0-9]?/
/*.*/ucbandeimg/
/*.*/utopiad\.(gif|jpg)
/*.*/werb\..*
/*.*/werbebanner/
/*.*/werbung/.*\.(gif|jpe?g)
/*ad.*.doubleclick.net
/.*(ms)?backoff(ice)?.*\.(gif|jpe?g)
/.*./Adverteerders/
/.*/?FPCreated\.gif
/.*/?va_banner.html
/.*/adv\.
/.*/advert[0-9]+\.jpg
/.*/favicon\.ico
/.*/ie_?(buttonlogo|static?|anim.*)?\.(gif|jpe?g)
/.*/ie_horiz\.gif
/.*/ie_logo\.gif
/.*/ns4\.gif
/.*/opera13\.gif
/.*/opera35\.gif
/.*/opera_b\.gif
/.*/v3sban\.gif
/.*Ad00\.gif
/.*activex.*(gif|jpe?g)
/.*add_active\.gif
/.*addchannel\.gif
/.*adddesktop\.gif
/.*bann\.gif
/.*barnes_logo\.gif
/.*book.search\.gif
/.*by/main\.gif
/.*cnnpostopinionhome.\.gif
/.*cnnstore\.gif
/.*custom_feature\.gif
/.*exc_ms\.gif
/.*explore.anim.*gif
/.*explorer?.(gif|jpe?g)
/.*freeie\.(gif|jpe?g)
/.*gutter117\.gif
/.*ie4_animated\.gif
/.*ie4get_animated\.gif
/.*ie_sm\.(gif|jpe?g)
/.*ieget\.gif
/.*images/cnnfn_infoseek\.gif
/.*images/pathfinder_btn2\.gif
/.*img/gen/fosz_front_em_abc\.gif
/.*img/promos/bnsearch\.gif
/.*infoseek\.gif
/.*logo_msnhm_*
/.*mcsp2\.gif
/.*microdell\.gif
/.*msie(30)?\.(gif|jpe?g)
/.*msn2\.gif
/.*msnlogo\.(gif|jpe?g)
/.*n_iemap\.gif
/.*n_msnmap\.gif
/.*navbars/nav_partner_logos\.gif
/.*nbclogo\.gif
/.*office97_ad1\.(gif|jpe?g)
/.*pathnet.warner\.gif
/.*pbbobansm\.(gif|jpe?g)
/.*powrbybo\.(gif|jpe?g)
/.*s_msn\.gif
/.*secureit\.gif
/.*sqlbans\.(gif|jpe?g)
/BannerImages/
/BarnesandNoble/images/bn.recommend.box.*
/Media/Images/Adds/
/SmartBanner/
/US/AD/
/_banner/
/ad[-_]container/
/adcycle.cgi
/adcycle/
/adgenius/
/adimages/
/adproof/
/adserve/
/affiliate_banners/
/annonser?/
/anz/pics/
/autoads/
/av/gifs/av_logo\.gif
/av/gifs/av_map\.gif
/av/gifs/new/ns\.gif
/bando/
/bannerad/
/bannerfarm/
/bin/getimage.cgi/...\?AD
/cgi-bin/centralad/
/cgi-bin/getimage.cgi/....\?GROUP=
/cgi-bin/nph-adclick.exe/
/cgi-bin/nph-load
/cgi-bin/webad.dll/ad
/cgi/banners.cgi
/cwmail/acc\.gif
/cwmail/amzn-bm1\.gif
/db_area/banrgifs/
/digitaljam/images/digital_ban\.gif
/free2try/
/gfx/bannerdir/
/gif/buttons/banner_.*
/gif/buttons/cd_shop_.*
/gif/cd_shop/cd_shop_ani_.*
/gif/teasere/
/grafikk/annonse/
/graphics/advert
/graphics/defaultAd/
/grf/annonif
/hotstories/companies/images/companies_banner\.gif
/htmlad/
/image\.ng/AdType
/image\.ng/transactionID
/images/.*/.*_anim\.gif
/images/adds/
/images/getareal2\.gif
/images/locallogo.gif
/img/special/chatpromo\.gif
/include/watermark/v2/
/ip_img/.*\.(gif|jpe?g)
/ltbs/cgi-bin/click.cgi
/marketpl*/
/markets/images/markets_banner\.gif
/minibanners/
/ows-img/bnoble\.gif
/ows-img/nb_Infoseek\.gif
/p/d/publicid
/pics/amzn-b5\.gif
/pics/getareal1\.gif
/pics/gotlx1\.gif
/promotions/
/rotads/
/rotations/
/torget/jobline/.*\.gif
/viewad/
/we_ba/
/werbung/
/world-banners/
/worldnet/ad\.cgi
/zhp/auktion/img/
""".strip().split("\n")
