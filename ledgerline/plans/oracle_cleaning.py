"""Independent DuckDB SQL for the layoffs and housing queries (see
plans/cleaning.py for the stand-ins)."""

LAYOFFS = """
lraw AS (
  SELECT CASE WHEN o.o_orderpriority = '5-LOW' THEN ' ' || c.c_name || ' ' ELSE c.c_name END AS company,
         n.n_name AS location,
         CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN ''
              WHEN o.o_orderstatus = 'P' THEN c.c_mktsegment || ' Goods'
              ELSE c.c_mktsegment END AS industry,
         CASE WHEN o.o_orderstatus = 'O' AND o.o_orderpriority = '1-URGENT' THEN NULL
              ELSE CAST(floor(o.o_totalprice / 1000) AS INTEGER) END AS total_laid_off,
         CASE WHEN o.o_orderstatus = 'O' AND o.o_orderpriority = '1-URGENT' THEN NULL
              WHEN o.o_orderpriority = '1-URGENT' THEN '1'
              WHEN o.o_orderpriority = '2-HIGH' THEN '0.95'
              WHEN o.o_orderpriority = '3-MEDIUM' THEN '1.0' ELSE '0.1' END AS percentage_laid_off,
         strftime(o.o_orderdate, '%-m/%-d/%Y') AS date,
         o.o_orderpriority AS stage,
         CASE WHEN o.o_orderstatus = 'P' THEN r.r_name || '.' ELSE r.r_name END AS country,
         CAST(floor(c.c_acctbal / 100) AS INTEGER) AS funds_raised_millions
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey),
ls1 AS (SELECT DISTINCT * FROM lraw),
ls2 AS (
  SELECT trim(company) AS company, location,
         NULLIF(CASE WHEN industry LIKE 'MACHINERY%' THEN 'MACHINERY' ELSE industry END, '') AS industry,
         total_laid_off, percentage_laid_off,
         CAST(strptime(date, '%m/%d/%Y') AS DATE) AS date, stage,
         CASE WHEN country LIKE 'AMERICA%' THEN rtrim(country, '.') ELSE country END AS country,
         funds_raised_millions
  FROM ls1),
ldonor AS (SELECT company, min(industry) AS d FROM ls2 WHERE industry IS NOT NULL GROUP BY company),
ls3 AS (SELECT l.company, l.location, COALESCE(l.industry, d.d) AS industry, l.total_laid_off,
               l.percentage_laid_off, l.date, l.stage, l.country, l.funds_raised_millions
        FROM ls2 l LEFT JOIN ldonor d ON l.company = d.company),
layoffs AS (SELECT * FROM ls3 WHERE NOT (total_laid_off IS NULL AND percentage_laid_off IS NULL))
"""

HOUSING = """
hraw AS (
  SELECT o.o_orderkey AS UniqueID, 'P-' || CAST(o.o_custkey AS VARCHAR) AS ParcelID,
         CASE WHEN o.o_orderpriority = '5-LOW' THEN NULL
              WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN c.c_name
              ELSE c.c_name || ', ' || n.n_name END AS PropertyAddress,
         date_trunc('month', o.o_orderdate) AS SaleDate,
         CAST(floor(o.o_totalprice / 10000) * 10000 AS BIGINT) AS SalePrice,
         o.o_orderstatus AS LegalReference,
         CASE WHEN o.o_orderpriority = '1-URGENT'
                THEN c.c_name || ', Unit 1, ' || n.n_name || ', ' || r.r_name || ', Earth'
              WHEN o.o_orderpriority = '5-LOW' THEN c.c_name || ', ' || n.n_name
              ELSE c.c_name || ', ' || n.n_name || ', ' || r.r_name END AS OwnerAddress,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Y' WHEN '2-HIGH' THEN 'N'
              WHEN '3-MEDIUM' THEN 'Yes' ELSE 'No' END AS SoldAsVacant,
         r.r_name AS TaxDistrict
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey),
hdonor AS (
  SELECT ParcelID, arg_min(PropertyAddress, UniqueID) AS d, COUNT(*) AS n
  FROM hraw WHERE PropertyAddress IS NOT NULL GROUP BY ParcelID),
hfilled AS (
  SELECT h.UniqueID, h.ParcelID, COALESCE(h.PropertyAddress, d.d) AS PropertyAddress, h.SaleDate,
         h.SalePrice, h.LegalReference, h.OwnerAddress, h.SoldAsVacant, h.TaxDistrict
  FROM hraw h LEFT JOIN hdonor d ON h.ParcelID = d.ParcelID)
"""


def _pn(col: str, n: int) -> str:
    parts = f"string_split(replace({col}, ',', '.'), '.')"
    return f"CASE WHEN len({parts}) BETWEEN {n} AND 4 THEN NULLIF({parts}[-{n}], '') END"


def _head(col: str) -> str:
    return f"CASE WHEN strpos({col}, ',') > 0 THEN substr({col}, 1, strpos({col}, ',') - 1) END"


def _tail(col: str) -> str:
    return f"substr({col}, strpos({col}, ',') + 1)"


def _l(body: str) -> str:
    return "WITH " + LAYOFFS + body


def _h(body: str) -> str:
    return "WITH " + HOUSING + body


SQL = {
"layoffs_clean": _l("SELECT * FROM layoffs"),
"layoffs_duplicate_rows": _l("""
, d AS (SELECT *, COUNT(*) AS n FROM lraw GROUP BY ALL HAVING COUNT(*) > 1)
SELECT company, location, industry, total_laid_off, percentage_laid_off, date, stage, country,
       funds_raised_millions, CAST(g.row_num AS INTEGER) AS row_num
FROM d, LATERAL (SELECT unnest(range(2, n + 1)) AS row_num) g"""),
"layoffs_dedup_audit": _l("""
SELECT (SELECT COUNT(*) FROM lraw) AS before_rows, (SELECT COUNT(*) FROM ls1) AS after_rows,
       (SELECT COUNT(*) FROM lraw) - (SELECT COUNT(*) FROM ls1) AS removed_rows"""),
"layoffs_peer_fill_preview": """WITH """ + LAYOFFS.split("ls2 AS")[0] + """
ls2 AS (
  SELECT trim(company) AS company, location,
         NULLIF(CASE WHEN industry LIKE 'MACHINERY%' THEN 'MACHINERY' ELSE industry END, '') AS industry,
         date, stage
  FROM ls1),
ldonor AS (SELECT company, min(industry) AS d, COUNT(*) AS n FROM ls2
           WHERE industry IS NOT NULL GROUP BY company)
SELECT t.location, t.stage, t.date, t.company, t.industry, d.d AS donor_value,
       COALESCE(d.n, 0) AS donor_count
FROM ls2 t LEFT JOIN ldonor d ON t.company = d.company
WHERE t.industry IS NULL""",
"industry_domain": _l("SELECT DISTINCT industry FROM layoffs"),
"parse_us_dates": """
SELECT o_orderkey, strftime(o_orderdate, '%-m/%-d/%Y') AS date_text,
       CAST(strptime(strftime(o_orderdate, '%-m/%-d/%Y'), '%m/%d/%Y') AS DATE) AS parsed_date
FROM orders""",
"max_measures": _l("""
SELECT MAX(total_laid_off) AS max_total_laid_off, MAX(percentage_laid_off) AS max_percentage_laid_off
FROM layoffs"""),
"complete_shutdowns": _l("SELECT * FROM layoffs WHERE CAST(percentage_laid_off AS DOUBLE) = 1"),
"total_by_company": _l("""
SELECT company, CAST(SUM(total_laid_off) AS BIGINT) AS total_laid_off FROM layoffs GROUP BY company"""),
"total_by_industry": _l("""
SELECT industry, CAST(SUM(total_laid_off) AS BIGINT) AS total_laid_off FROM layoffs GROUP BY industry"""),
"total_by_stage": _l("""
SELECT stage, CAST(SUM(total_laid_off) AS BIGINT) AS total_laid_off FROM layoffs GROUP BY stage"""),
"total_by_year": _l("""
SELECT CAST(year(date) AS INTEGER) AS year, CAST(SUM(total_laid_off) AS BIGINT) AS total_laid_off
FROM layoffs GROUP BY year(date)"""),
"rolling_total_by_year": _l("""
, t AS (SELECT substring(CAST(date AS VARCHAR), 1, 4) AS period,
               CAST(SUM(total_laid_off) AS BIGINT) AS total_off
        FROM layoffs WHERE substring(CAST(date AS VARCHAR), 1, 4) IS NOT NULL GROUP BY 1)
SELECT period, total_off, CAST(SUM(total_off) OVER (ORDER BY period) AS BIGINT) AS rolling_total FROM t"""),
"rolling_total_by_month": _l("""
, t AS (SELECT substring(CAST(date AS VARCHAR), 1, 7) AS period,
               CAST(SUM(total_laid_off) AS BIGINT) AS total_off
        FROM layoffs WHERE substring(CAST(date AS VARCHAR), 1, 7) IS NOT NULL GROUP BY 1)
SELECT period, total_off, CAST(SUM(total_off) OVER (ORDER BY period) AS BIGINT) AS rolling_total FROM t"""),
"top_companies_per_year": _l("""
, cy AS (SELECT company, CAST(year(date) AS INTEGER) AS years,
                CAST(SUM(total_laid_off) AS BIGINT) AS total_laid_off
         FROM layoffs GROUP BY company, year(date)),
r AS (SELECT *, dense_rank() OVER (PARTITION BY years ORDER BY total_laid_off DESC) AS ranking
      FROM cy WHERE years IS NOT NULL)
SELECT company, years, total_laid_off, CAST(ranking AS INTEGER) AS ranking FROM r WHERE ranking <= 5"""),
"housing_clean": _h(f"""
, h2 AS (
  SELECT UniqueID, ParcelID, PropertyAddress, SaleDate, SalePrice, LegalReference,
         CASE SoldAsVacant WHEN 'Y' THEN 'Yes' WHEN 'N' THEN 'No' ELSE SoldAsVacant END AS SoldAsVacant,
         CAST(SaleDate AS DATE) AS SaleDateConverted,
         {_head('PropertyAddress')} AS PropSplitAddress, {_tail('PropertyAddress')} AS PropSplitCity,
         {_pn('OwnerAddress', 3)} AS OwnerSplitAddress, {_pn('OwnerAddress', 2)} AS OwnerSplitCity,
         {_pn('OwnerAddress', 1)} AS OwnerSplitState,
         row_number() OVER (PARTITION BY ParcelID, PropertyAddress, SaleDate, SalePrice, LegalReference
                            ORDER BY UniqueID) AS rn
  FROM hfilled)
SELECT UniqueID, ParcelID, SalePrice, LegalReference, SoldAsVacant, SaleDateConverted,
       PropSplitAddress, PropSplitCity, OwnerSplitAddress, OwnerSplitCity, OwnerSplitState
FROM h2 WHERE rn = 1"""),
"housing_fill_preview": _h("""
SELECT a.UniqueID, a.ParcelID, a.PropertyAddress, d.d AS donor_value, COALESCE(d.n, 0) AS donor_count
FROM hraw a LEFT JOIN hdonor d ON a.ParcelID = d.ParcelID
WHERE a.PropertyAddress IS NULL"""),
"housing_split_address": _h(f"""
SELECT UniqueID, PropertyAddress, {_head('PropertyAddress')} AS PropSplitAddress,
       {_tail('PropertyAddress')} AS PropSplitCity FROM hfilled"""),
"housing_split_owner": _h(f"""
SELECT UniqueID, OwnerAddress, {_pn('OwnerAddress', 3)} AS OwnerSplitAddress,
       {_pn('OwnerAddress', 2)} AS OwnerSplitCity, {_pn('OwnerAddress', 1)} AS OwnerSplitState
FROM hraw"""),
"sold_as_vacant_histogram": _h("""
SELECT SoldAsVacant, COUNT(SoldAsVacant) AS n FROM hraw GROUP BY SoldAsVacant"""),
"sold_as_vacant_recode": _h("""
SELECT UniqueID, SoldAsVacant,
       CASE WHEN SoldAsVacant = 'Y' THEN 'Yes' WHEN SoldAsVacant = 'N' THEN 'No'
            ELSE SoldAsVacant END AS Revised
FROM hraw"""),
"housing_dedup": _h("""
SELECT UniqueID, ParcelID, PropertyAddress, SaleDate, SalePrice, LegalReference FROM (
  SELECT *, row_number() OVER (PARTITION BY ParcelID, PropertyAddress, SaleDate, SalePrice,
                                            LegalReference ORDER BY UniqueID) AS rn
  FROM hraw) WHERE rn = 1"""),
"housing_sale_dates": _h("""
SELECT UniqueID, SaleDate, CAST(SaleDate AS DATE) AS SaleDateConverted FROM hraw"""),
}
