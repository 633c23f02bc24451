"""Column layouts shared by sources, operators and sinks."""

#: One row per annotation file; text stays raw until it is typed.
ANNOTATION_XML = "filename STRING, path STRING, size STRUCT<width: STRING, height: STRING>, object ARRAY<STRUCT<name: STRING, bndbox: STRUCT<xmin: STRING, ymin: STRING, xmax: STRING, ymax: STRING>>>, _corrupt_record STRING"

SPLITS = ("test", "train", "val")
MANIFEST_COLUMNS = ("image_id", "split", "image_path", "label_path", "source_image_path", "source_xml_path", "image_width", "image_height", "object_count", "small_box_count", "duplicate_group_id")
FINDING_CATEGORIES = ("missing_images", "missing_xml", "extension_mismatches", "invalid_annotations", "invalid_boxes", "small_boxes", "corrupt_images", "duplicate_images")
#: What an audit report calls the categories, and the totals of its summary.
REPORT_CATEGORIES = {
    "invalid_annotations": "invalid_annotations", "invalid_boxes": "invalid_bounding_boxes", "missing_images": "missing_images_for_xml", "missing_xml": "missing_xml_for_images",
    "extension_mismatches": "filename_extension_mismatches", "corrupt_images": "corrupt_images", "duplicate_images": "duplicate_images", "small_boxes": "very_small_bounding_boxes",
}
REPORT_TOTALS = {"images": "total_images", "annotations": "total_xml_annotations", "objects": "total_annotated_objects"}
#: Suffixes that count as images in an audit and in a conversion.
AUDIT_SUFFIXES = ("bmp", "gif", "jpeg", "jpg", "png", "tif", "tiff", "webp")
CONVERT_SUFFIXES = ("jpeg", "jpg", "png")
SOURCE_CLASS, SMALL_SIDE = "fore", 10.0
#: Status words of the full review and of the preview review.
PASS, NEEDS_REVIEW, REJECT = "PASS", "NEEDS_REVIEW", "REJECT"
PREVIEW_WORDS = {PASS: "Pass", NEEDS_REVIEW: "Needs review", REJECT: "Reject"}
#: Columns of a review report, and what of the reviews they hold.
REVIEW_COLUMNS = {
    "image_id": "image_id", "split": "split", "source_image_path": "source_image_path", "source_xml_path": "source_xml_path", "yolo_label_path": "label_path",
    "source_object_count": "source_count", "converted_object_count": "converted_count", "max_coordinate_delta_px": "max_delta",
    "minimum_matched_iou": "min_iou", "mean_matched_iou": "mean_iou", "unmatched_source_boxes": "unmatched_source",
    "unmatched_converted_boxes": "unmatched_converted", "very_small_box_count": "small", "duplicate_group_id": "group",
    "duplicate_crosses_split": "duplicate_crosses_split", "automated_status": "status", "automated_reasons": "reasons",
}
